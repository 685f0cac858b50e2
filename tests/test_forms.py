"""Each kind of rule on a text that keeps it and on one that doesn't."""

import math

import pytest

from quire.operators import forms, structure
from quire.operators.forms import Rule

SCHEMA = "work_id long, lines array<array<string>>, stanzas array<int>, syllables array<int>, stresses array<int>, endings array<string>, initials array<string>, labels array<string>, vowels array<string>, alliteration array<double>, credits array<struct<i:int,j:int,credit:double>>, qafias array<array<array<string>>>"


def work(n=0, lines=None, stanzas=None, syl=None, stress=None, labels=None, vowels=None, initials=None, allit=None, credits=(), qafias=None, endings=None):
    """An observation; lines that aren't given have words of their own."""
    n = n or max(len(x) for x in (lines or [], syl or [], stress or [], labels or [], vowels or [], initials or [], allit or [], endings or [], [0] * sum(stanzas or [])))
    lines = [x.split() if isinstance(x, str) else x for x in lines or [f"l{i} m{i} n{i}" for i in range(n)]]
    pad = lambda x: list(x) if x else [None] * len(lines)
    return lines, stanzas or [len(lines)], pad(syl), pad(stress), pad(endings or [x[-1] for x in lines]), pad(initials), pad(labels), pad(vowels), pad(allit), list(credits), pad(qafias)


def repeats(n, groups, change=None):
    """Lines that repeat where they should; ``change``: one that doesn't quite."""
    lines = [f"l{i} m{i} n{i} o{i}" for i in range(1, n + 1)]
    for g in groups:
        for x in g[1:]:
            lines[x - 1] = lines[g[0] - 1]
    if change:
        lines[change - 1] = " ".join(lines[change - 1].split()[:2] + ["other", "words"])
    return work(lines=lines)


def cycle(values, n):
    return [values[k % len(values)] for k in range(n)]


SEED = "abcdef"
SESTINA = [SEED[k] for k in forms.ROTATION]
ENVOI = ["b x e", "d x c", "f x a"]
GHAZAL = ["x1 bright in the night", "x2 light in the night", "free line", "x3 sight in the night", "free too", "x4 white in the night"]
RIME = {"bright": ["AY1", "T"], "light": ["AY1", "T"], "sight": ["AY1", "T"], "white": ["AY1", "T"], "dull": ["AH1", "L"]}
Q = lambda lines: [[RIME.get(w) for w in reversed(x.split()[:-1][-4:])] + [None] * (4 - len(x.split()[:-1][-4:])) for x in lines]
#: kind -> parameters, a work that scores 1, another one with its score and coverage.
CASES = {
    "line_count_exact": ({"count": 14}, work(14), work(12), 1 - 2 / 3.5, 1), "line_count_range": ({"minimum": 3, "maximum": 8}, work(8), work(10), 1 - 2 / 3, 1),
    "word_count_pattern": ({"counts": [1, 2, 1]}, work(lines=["a", "b c", "d"]), work(lines=["a", "b c d"]), 0.75, 2 / 3), "maximum_word_length": ({"maximum": 3}, work(lines=["abc de"]), work(lines=["abcd e"]), 0.5, 1),
    "total_syllable_range": ({"minimum": 10, "maximum": 12}, work(syl=[5, 6]), work(syl=[5, None]), None, 0.5), "maximum_total_syllables": ({"maximum": 10}, work(syl=[5, 5]), work(syl=[10, 5]), 0.5, 1),
    "syllable_range": ({"minimum": 9, "maximum": 11}, work(syl=[9, 11]), work(syl=[10, 12, None]), 0.75, 2 / 3), "stress_count_range": ({"minimum": 3, "maximum": 5}, work(stress=[3, 5]), work(stress=[3, None, 6, 4]), (2 + 0.5) / 3, 0.75),
    "stanza_pattern": ({"patterns": [[4, 4], [3, 3]]}, work(stanzas=[3, 3]), work(stanzas=[4, 2]), (1 + 0.75) / 2, 1), "uniform_stanza_size": ({"size": 2, "minimum": 2}, work(stanzas=[2, 2]), work(stanzas=[2]), 0.5, 1),
    "alternating_stanza_sizes": ({"sizes": [4, 3]}, work(stanzas=[4, 3, 4]), work(stanzas=[4, 4]), 0.75, 1), "quatrain_sequence": ({"minimum": 2}, work(stanzas=[4, 4]), work(stanzas=[4, 3]), 0.25, 1),
    "terza_stanzas": ({}, work(stanzas=[3, 3, 1]), work(stanzas=[3, 4]), 0.4, 1), "ghazal_architecture": ({"minimum": 5, "maximum": 15}, work(stanzas=[2] * 5), work(stanzas=[2, 2, 2, 1]), (0.75 + 0.6) / 2, 1),
    "chanso_architecture": ({}, work(stanzas=[8] * 5 + [4]), work(stanzas=[8] * 4), None, 1),
    "syllable_pattern": ({"counts": [5, 7, 5]}, work(syl=[5, 7, 5]), work(syl=[5, None, 4, 9]), (1 + 2 / 3) / 2, 2 / 3), "syllable_pattern_repeating": ({"counts": [8, 6]}, work(syl=[8, 6, 8]), work(syl=[8, 8, 8, None]), (2 + 1 / 3) / 3, 0.75),
    "syllable_pattern_alternatives": ({"patterns": [[7, 5], [8, 6]]}, work(syl=[8, 6]), work(syl=[8, 5]), 5 / 6, 1), "choka_syllable_pattern": ({}, work(syl=[5, 7, 5, 7, 7]), work(syl=[5, 7, 5]), (2 + 1 / 3) / 3, 1),
    "stress_count_pattern_repeating": ({"counts": [4, 3]}, work(stress=[4, 3, 4, 3]), work(stress=[4, 4, None, None]), 0.75, 0.5),
    "line_length_uniformity": ({}, work(syl=[10, 10, 10]), work(syl=[8, 10, 12]), 1 - math.sqrt(8 / 3) / 10 / 0.35, 1), "line_length_variation": ({"minimum_cv": 0.25}, work(syl=[4, 10, 4, 10]), work(syl=[10, 10, 10, None]), 0, 0.75),
    "terminal_line_longer": ({"period": 3}, work(syl=[8, 8, 12, 8, 8, 10]), work(syl=[8, 8, 8, 8, None, 9]), 1 / 3, 0.5), "terminal_line_shorter": ({}, work(syl=[10, 10, 5]), work(syl=[10, None, 10]), 1 / 3, 2 / 3),
    "periodic_line_length_relation": ({"period": 3, "long_positions": [1, 2], "short_positions": [3]}, work(syl=[8, 8, 4, 9, 9, 4]), work(syl=[8, 8, 8, 9, 9]), 1 / 3, 0.5),
    "limerick_length_relation": ({}, work(syl=[9, 9, 5, 5, 9]), work(syl=[9, 9, None, 5]), None, 0.6), "alphabetic_line_initials": ({}, work(initials=list("abcd")), work(initials=["a", "c", None, "d"]), 2 / 3, 0.75),
    "rhyme_scheme": ({"schemes": ["AA BB", "AB AB"]}, work(labels=["x", "y", "x", "y"]), work(labels=["x", "x", "x", None], credits=[(1, 2, 0.5)]), (1 + 0) / 2, 0.5),
    "rhyme_scheme_repeating": ({"scheme": "AA"}, work(labels=["x", "x", "y", "y"]), work(labels=["x", "y", "x", "z"], credits=[(1, 2, 0.8)]), (0.4 + 0.75) / 2, 1),
    "rhyme_absence": ({"maximum_density": 0.2}, work(labels=["x", "y", "z"]), work(labels=["x", "x", "y", "z", None]), 1 - 0.3 / 0.8, 1), "rhyme_couplets": ({}, work(labels=["x", "x", "y", "y"]), work(labels=["x", "y", "z", None], credits=[(1, 2, 0.25)]), 0.25, 0.5),
    "terminal_rhyming_couplet": ({}, work(labels=["q", "x", "x"]), work(labels=["x", "x", "y"]), 0, 1), "terminal_pair_rhyme": ({"positions": [3, 1]}, work(labels=["x", "y", "x"]), work(labels=["x", "x"]), None, 0),
    "terza_rhyme": ({}, work(labels=list("abab") + ["c", "b"]), work(labels=list("aba")), None, 0), "rubaiyat_chain": ({}, work(labels=list("aabab") + ["b", "c", "b"]), work(labels=list("abcd")), (0 + 1) / 2, 1),
    "monorhyme": ({}, work(labels=["x", "x"]), work(labels=["x", "y", "x", None]), 2 / 3, 0.75), "rhyme_class_count": ({"count": 2}, work(labels=["x", "y", "x"]), work(labels=["x", "y", "z", None]), 0.5, 0.75),
    "even_line_assonance": ({}, work(vowels=[None, "o", "i", "o"]), work(vowels=["o", "a", "o", "e", "o", None]), 0.5, 2 / 3), "seguidilla_assonance": ({}, work(vowels=["i", "o", "i", "o"]), work(vowels=["a", None]), None, 0),
    **{k: ({}, repeats(max(map(max, g)), g), repeats(max(map(max, g)), g, g[0][1]), 1 - 0.5 / sum(len(x) - 1 for x in g), 1) for k, g in forms.REPEATS.items()},
    "line_repetition_groups": ({"groups": [[1, 4, 7], [2, 8]]}, repeats(8, [(1, 4, 7), (2, 8)]), repeats(7, [(1, 4, 7)], 7), (1 + 0.5) / 2, 2 / 3), "first_last_line_echo": ({}, repeats(6, [(1, 6)]), work(lines=["a b c", "x", "a b d"]), 2 / 3, 1),
    "duplex_echo": ({}, repeats(6, [(2, 3), (4, 5)]), work(lines=["a", "b c", "b d", "e"]), 0.5, 1), "rondel_refrains": ({}, repeats(14, [(1, 7, 13), (2, 8, 14)]), repeats(13, [(1, 7, 13), (2, 8)], 13), 1 - 0.5 / 3, 1),
    "sonnet_crown_links": ({"sonnet_count": 3}, repeats(28, [(14, 15)]), repeats(14, []), None, 0), "stanza_refrain": ({}, (repeats(6, [(2, 4, 6)])[0], [2, 2, 2], *work(6)[2:]), (repeats(6, [(2, 4)])[0], [2, 2, 2], *work(6)[2:]), 0.5, 1),
    "pantoum_repetition": ({}, (repeats(8, [(2, 5), (4, 7)])[0], [4, 4], *work(8)[2:]), (repeats(8, [(2, 5), (4, 7)], 7)[0], [4, 4], *work(8)[2:]), 0.75, 1), "pantoum_closure": ({}, (repeats(8, [(1, 8), (3, 6)])[0], [4, 4], *work(8)[2:]), work(stanzas=[4, 3]), None, 1),
    "blues_repetition": ({}, repeats(6, [(1, 2), (4, 5)]), (["a b".split(), "a c".split(), ["d"], ["e"], ["f"]], [3, 2], *work(5)[2:]), 0.5, 1),
    "partial_refrain_positions": ({"anchor": 1, "positions": [3, 5]}, work(lines=["a b c d e f", "x", "a b c", "y", "a b c d e f"]), work(lines=["a b c d", "x", "a q"]), 0.5, 0.5),
    "sestina_rotation": ({}, work(endings=SESTINA), work(endings=list("abcdef") + ["x"] * 6), 0.5, 1 / 3), "sestina_envoi": ({}, work(lines=[f"q{i} {w}" for i, w in enumerate(SESTINA)] + ENVOI), work(38), None, 2 / 3),
    "ghazal_radif_qafia": ({}, work(lines=GHAZAL, qafias=Q(GHAZAL)), work(lines=[x.replace("light", "dull") for x in GHAZAL], qafias=Q([x.replace("light", "dull") for x in GHAZAL])), 0.65 + 0.35 * 2 / 3, 1),
    "alliteration_density": ({"minimum": 0.3}, work(allit=[0.3, 0.5]), work(allit=[0.1, 0.2, None]), 0.5, 2 / 3), "manual_requirement": ({}, None, work(3), None, 0),
}


def test_every_kind(spark):
    assert set(CASES) == set(forms.KINDS)
    rows = [(2 * k + side, *case[1 + side]) for k, case in enumerate(CASES.values()) for side in (0, 1) if case[1 + side]]
    registry = {kind: [Rule("r", kind, case[0])] for kind, case in CASES.items()}
    forms.check_registry(registry)
    found = {(r.work_id, r.form): r for r in forms.score_rules(spark.createDataFrame(rows, SCHEMA), registry).collect()}
    assert len(found) == len(rows) * len(CASES)
    for k, (kind, (_, good, _, score, coverage)) in enumerate(CASES.items()):
        if good:
            assert (found[2 * k, kind].score, found[2 * k, kind].coverage) == (pytest.approx(1), pytest.approx(1)), kind
        r = found[2 * k + 1, kind]
        assert (r.score if score is None else pytest.approx(r.score)) == score and r.coverage == pytest.approx(coverage), (kind, r.score, r.coverage)
    assert all(r.score is None or 0 <= r.score <= 1 for r in found.values())


def test_an_unknown_kind(spark):
    with pytest.raises(ValueError, match="no rule of kind"):
        forms.check_registry({"x": [Rule("r", "unheard of", {})]})
    with pytest.raises(TypeError):
        forms.check_registry({"x": [Rule("r", "line_count_exact", {"number": 3})]})


def test_candidates(spark):
    scores = [(1, "a", "r1", 3.0, True, 0.9, 1.0), (1, "a", "r2", 1.0, False, 0.5, 1.0), (1, "b", "r", 1.0, True, 0.6, 1.0), (1, "c", "r", 1.0, True, 0.95, 1.0), (1, "d", "r", 2.0, True, 0.1, 1.0), (1, "d", "s", 2.0, False, 1.0, 1.0), (1, "e", "r", 1.0, True, None, 0.0)]
    rows = {r.form: r for r in forms.candidates(spark.createDataFrame(scores, "work_id long, form string, rule string, weight double, required boolean, score double, coverage double"), {"c": "manual"}).collect()}
    assert [f for f, _ in sorted(rows.items(), key=lambda x: x[1].place)] == ["a", "b", "d", "c", "e"]
    assert (rows["a"].consistency, rows["a"].margin, rows["a"].confidence, rows["a"].classification) == (pytest.approx(0.8), pytest.approx(0.2), "high", "Modified")
    assert (rows["b"].margin, rows["b"].confidence, rows["c"].classification, rows["c"].suggested) == (pytest.approx(0.05), "moderate", "Manual confirmation required", False)
    assert (rows["d"].contradictions, rows["d"].suggested, rows["d"].classification) == (1, False, "No match")
    assert (rows["e"].consistency, rows["e"].margin, rows["e"].evidence, rows["e"].required_evidence) == (None, None, 0.0, 0.0)


def test_observations(spark):
    works = spark.createDataFrame([(1, "the cat sat\nthe hat\n\na cold clear night\nso bright 12")], "work_id long, text string")
    lines = structure.stanzas(structure.lines(works))
    sounds = spark.createDataFrame([(1, 1, "AE T", "AE", 2, [(2, 0.8)], [["x"], None, None, None]), (1, 5, "AY T", "AY", None, None, None)], "work_id long, line_no int, label string, vowel string, stresses int, credits array<struct<line_no:int,credit:double>>, qafias array<array<string>>")
    row = forms.observations(lines, sounds).first()
    assert (row.lines[0], row.stanzas, row.endings, row.initials) == (["the", "cat", "sat"], [2, 2], ["sat", "hat", "night", "bright"], ["t", "t", "a", "s"])
    assert (row.labels, row.vowels, row.stresses) == (["AE T", None, None, "AY T"], ["AE", None, None, "AY"], [2, None, None, None])
    assert [tuple(c) for c in row.credits] == [(1, 2, 0.8)] and row.alliteration == [0.0, 0.0, pytest.approx(2 / 3), 0.0]
    bare = forms.observations(lines).first()
    assert bare.labels == [None] * 4 and bare.credits == [] and bare.lines == row.lines
    assert forms.observations(lines.limit(0)).count() == 0
