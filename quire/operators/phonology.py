"""Pronunciations of tokens and lines, and the rhyme of line endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio

#: Weights of rhyme similarity, the score of related vowels, and the least similarity of a slant rhyme.
WEIGHTS = {"vowel": 0.35, "consonants": 0.25, "edit": 0.25, "stress": 0.10, "syllables": 0.05}
RELATED, SLANT = 0.6, 0.68


def dictionary(pronunciations: DataFrame) -> DataFrame:
    """One row a word: its variants, and what they agree on.  ``pronunciations``: lookup_form, variant, phones, stress,
    syllables."""
    signature = F.concat_ws(":", F.col("syllables").cast("string"), F.col("stress"))
    return pronunciations.groupBy(F.col("lookup_form").alias("form")).agg(
        F.count("*").alias("variants"), F.countDistinct(signature).alias("signatures"), F.min("syllables").alias("least"),
        F.first("stress").alias("stress"), F.first("syllables").alias("syllables"), F.transform(F.array_sort(F.collect_list(F.struct("variant", "phones"))), lambda x: x["phones"]).alias("phones"),
    )


def resolve(token_rows: DataFrame, words: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds status, resolved, stress and syllables: an override, the only variant, what all variants agree on, or nothing;
    no variant is chosen silently.  ``words``: of ``dictionary``; ``overrides``: form, own_stress, own_syllables."""
    rows = token_rows.join(words, "form", "left").join(overrides, "form", "left")
    status = (
        F.when(F.col("own_stress").isNotNull(), "override").when(F.col("variants").isNull(), "unmatched").when(F.col("least") == 0, "no_vowel")
        .when(F.col("variants") == 1, "unique").when(F.col("signatures") == 1, "consensus").otherwise("ambiguous")
    )
    rows = rows.withColumn("status", status).withColumn("resolved", status.isin("override", "unique", "consensus"))
    known = lambda c: F.when(F.col("status") == "override", F.col(f"own_{c}")).when(F.col("resolved"), F.col(c))
    return rows.select(*token_rows.columns, "status", "resolved", known("stress").alias("stress"), known("syllables").alias("syllables"))


def pronounced_lines(resolved: DataFrame) -> DataFrame:
    """Per line: tokens by status, coverage, and where every token is resolved its syllables, stress and stress density."""
    n, done = F.count("*"), F.count_if("resolved")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("stress", F.lit("")).alias("s")))), lambda x: x["s"]), "")
    lines = resolved.groupBy("work_id", "line_no").agg(n.alias("eligible"), done.alias("resolved"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "unmatched").alias("unmatched"), F.sum("syllables").alias("all"), whole.alias("sequence"))
    complete = F.col("resolved") == F.col("eligible")
    lines = lines.withColumn("coverage", ratio("resolved", "eligible")).withColumn("syllables", F.when(complete, F.col("all"))).withColumn("stress", F.when(complete, F.col("sequence")))
    strong = F.length(F.regexp_replace("stress", "0", ""))
    return lines.withColumn("stress_density", strong / F.nullif("syllables", F.lit(0))).drop("all", "sequence")


def pronounced_types(resolved: DataFrame) -> DataFrame:
    """Per word: occurrences (``n`` of each row), statuses, and the syllables and stress that all of its resolved tokens share."""
    agreed = lambda c: F.when(F.countDistinct(c) == 1, F.max(c)).alias(c)
    return resolved.groupBy("form").agg(F.sum("n").alias("occurrences"), F.array_sort(F.collect_set("status")).alias("statuses"), agreed("stress"), agreed("syllables"))


def ending(phones: Column) -> Column:
    """The rhyme of one pronunciation, a struct: part (phones from the last primary-stressed vowel on, else secondary, else
    any, without digits, joined by spaces), vowel, stress, syllables, consonants after the last vowel, and shape.
    Null without a vowel."""
    at = lambda c, pattern: F.array_max(F.filter(F.transform(c, lambda p, i: F.when(p.rlike(pattern), i)), lambda i: i.isNotNull()))
    bare = lambda c: F.transform(c, lambda p: F.regexp_replace(p, "[012]$", ""))
    start = F.coalesce(at(phones, "1$"), at(phones, "2$"), at(phones, "0$"))
    suffix = F.slice(phones, start + 1, F.size(phones))
    vowels = F.filter(suffix, lambda p: p.rlike("[012]$"))
    stress = F.array_join(F.transform(vowels, lambda p: F.right(p, F.lit(1))), "")
    last = at(suffix, "[012]$")
    shape = F.when(F.size(vowels) == 1, "masculine").when(F.right(stress, F.lit(1)) == "0", "feminine").otherwise("multisyllabic")
    parts = F.struct(F.array_join(bare(suffix), " ").alias("part"), F.get(bare(suffix), F.lit(0)).alias("vowel"), stress.alias("stress"), F.size(vowels).alias("syllables"), F.array_join(F.slice(suffix, last + 2, F.size(suffix)), " ").alias("consonants"), shape.alias("shape"))
    return F.when(start.isNotNull(), parts)


def ending_words(words: DataFrame) -> DataFrame:
    """form, endings (the distinct rhymes of its variants) and part, where they all share one."""
    endings = F.array_distinct(F.filter(F.transform("phones", ending), lambda e: e.isNotNull()))
    rows = words.select("form", endings.alias("endings"))
    parts = F.array_distinct(F.transform("endings", lambda e: e["part"]))
    return rows.withColumn("part", F.when(F.size(parts) == 1, F.get(parts, F.lit(0))))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two sequences of one-character items joined by spaces or by nothing."""
    x, y = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    return F.when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))))


def similarity(a: Column, b: Column, family: Column) -> Column:
    """Of two endings; ``family`` maps a vowel to the name of its family."""
    vowel = F.when(a["vowel"] == b["vowel"], 1.0).when(F.element_at(family, a["vowel"]) == F.element_at(family, b["vowel"]), RELATED).otherwise(0.0)
    n, m = a["syllables"], b["syllables"]
    syllables = F.when(n == m, 1.0).otherwise(1 - F.abs(n - m) / F.greatest(n, m))
    return WEIGHTS["vowel"] * vowel + WEIGHTS["consonants"] * edit_similarity(a["consonants"], b["consonants"]) + WEIGHTS["edit"] * edit_similarity(a["part"], b["part"]) + WEIGHTS["stress"] * edit_similarity(a["stress"], b["stress"]) + WEIGHTS["syllables"] * syllables


def rhyme_pairs(endings: DataFrame, family: Column) -> DataFrame:
    """Pairs of line endings of a stanza with their relation: identical, perfect, slant or none, and eye rhymes.  A stanza's
    lines meet on its own key; ``endings``: work_id, stanza_no, line_no, form, rime, endings, part.  Each distinct pair of
    words is scored once."""
    lines = endings.filter(F.size("endings") > 0)
    side = lambda x: lines.select("work_id", "stanza_no", F.col("line_no").alias("line_" + x), F.col("form").alias("form_" + x))
    pairs = side("a").join(side("b").hint("shuffle_merge"), ["work_id", "stanza_no"]).filter("line_a < line_b")
    words = lines.select("form", "rime", "endings", "part").dropDuplicates(["form"])
    word = lambda x: words.select(*[F.col(c).alias(f"{c}_{x}") for c in words.columns]).hint("shuffle_merge")
    kinds = pairs.select("form_a", "form_b").distinct().join(word("a"), "form_a").join(word("b"), "form_b")
    scores = F.flatten(F.transform("endings_a", lambda a: F.transform("endings_b", lambda b: similarity(a, b, family))))
    kinds = kinds.withColumn("least", F.array_min(scores)).withColumn("most", F.array_max(scores))
    same = F.coalesce(F.col("part_a") == F.col("part_b"), F.lit(False))
    relation = F.when(same & (F.col("form_a") == F.col("form_b")), "identical").when(same, "perfect").when(F.round("least", 9) >= SLANT, "slant").when(F.round("most", 9) >= SLANT, "ambiguous").otherwise("none")
    eye = (F.length("rime_a") >= 2) & (F.col("rime_a") == F.col("rime_b")) & ~same
    kinds = kinds.select("form_a", "form_b", "least", "most", relation.alias("relation"), eye.alias("eye"))
    return pairs.join(kinds.hint("shuffle_merge"), ["form_a", "form_b"])


def rhyme_summary(endings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per stanza: lines, analysable ones, coverage, pairs by relation, and the share of lines in a perfect or identical one."""
    lines = endings.groupBy("work_id", "stanza_no").agg(F.count("*").alias("lines"), F.count_if(F.size("endings") > 0).alias("analysed"))
    full = F.col("relation").isin("perfect", "identical")
    counts = pairs.groupBy("work_id", "stanza_no").agg(F.count_if(full).alias("perfect"), F.count_if(F.col("relation") == "slant").alias("slant"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(full, F.array("line_a", "line_b")))))).alias("rhymed"))
    joined = lines.join(counts.hint("shuffle_merge"), ["work_id", "stanza_no"], "left").fillna(0, ["perfect", "slant", "rhymed"])
    return joined.withColumn("coverage", ratio("analysed", "lines")).withColumn("density", ratio("rhymed", "analysed"))


def sound_families(sounds: DataFrame) -> DataFrame:
    """(work_id, category, sound): occurrences, lines, and share of the category.  ``sounds``: work_id, line_no, category, sound."""
    lines = sounds.groupBy("work_id", "line_no", "category", "sound").agg(F.count("*").alias("n"))
    counts = lines.groupBy("work_id", "category", "sound").agg(F.sum("n").alias("n"), F.count("*").alias("lines"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("work_id", "category"))))


def caesurae(token_rows: DataFrame) -> DataFrame:
    """Punctuation of a line with a word on both sides, strong or moderate.  ``token_rows``: work_id, line_no, line_pos,
    surface, is_punct."""
    line = Window.partitionBy("work_id", "line_no").orderBy("line_pos")
    before = F.last(F.when(~F.col("is_punct"), F.col("line_pos")), True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(~F.col("is_punct"), F.col("line_pos")), True).over(line.rowsBetween(1, Window.unboundedFollowing))
    strength = F.when(F.col("surface").rlike("[;:—–!?]"), "strong").when(F.col("surface").rlike("[,…-]"), "moderate")
    rows = token_rows.withColumn("before", before).withColumn("after", after).withColumn("strength", strength)
    return rows.filter("is_punct and strength is not null and before is not null and after is not null").select("work_id", "line_no", "line_pos", "surface", "before", "after", "strength", F.when(F.col("strength") == "strong", 0.86).otherwise(0.68).alias("confidence"))


def prominence(stress: Column, is_function: Column, phrase_final: Column) -> Column:
    """Prominence of a syllable by its stress digit, or by the word's class where it has none; more at a phrase's end."""
    value = F.when(stress == "1", 1.0).when(stress == "2", 0.68).when(is_function, 0.12).otherwise(0.34)
    return F.least(value + F.when(phrase_final, 0.08).otherwise(0.0), F.lit(1.0))


def rhythm(lines: DataFrame) -> DataFrame:
    """Per work: lines, mean and spread of syllables, entropy of the lengths, the share of the commonest one, and whether
    odd and even lines each have one length of their own.  ``lines``: work_id, place, syllables."""
    counts = lines.groupBy("work_id", "syllables").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("work_id"))
    modes = counts.withColumn("share", share).groupBy("work_id").agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy"), F.max("share").alias("modal_share"))
    odd = F.col("place") % 2 == 1
    per = lines.groupBy("work_id").agg(F.count("*").alias("lines"), F.avg("syllables").alias("mean"), F.stddev_pop("syllables").alias("sd"), F.countDistinct(F.when(odd, F.col("syllables"))).alias("odd"), F.countDistinct(F.when(~odd, F.col("syllables"))).alias("even"), F.countDistinct("syllables").alias("kinds"))
    return per.join(modes.hint("shuffle_merge"), "work_id").withColumn("alternates", (F.col("odd") == 1) & (F.col("even") == 1) & (F.col("kinds") == 2)).drop("odd", "even", "kinds")
