r"""Mixing sources to target weights, in DataFrame functions only.

A source with the share p of all tokens gets the weight p**a / sum(p**a).  Exponent 1 keeps the shares
and 0 makes them equal; the entropy of the weights falls and the most repeated source is repeated less
as the exponent grows, so both targets are met by bisection on it, each step a small aggregate over one
row a source.  The mix takes the flattest weights that exceed neither ``target_entropy`` (a fraction of
the entropy of equal weights) nor ``max_repeats``; an entropy below that of the shares takes an exponent above 1.

The weights are realised as budgeted permutations.  A source's budget is its weight times the budget of
all; it is spent in epochs, each a permutation of the source's documents by a seeded hash: whole epochs
take every document, the last takes documents in its order until the budget is reached.  A document's
place in its source's stream, as a fraction of the source's budget, gives its block, so that every block
of about ``block_tokens`` holds all sources in the target weights; inside a block the order is random.

Running sums have two levels: sums of slots (ranges of the hash), then sums inside a slot.  Slots grow
in number with the table, so a source with a third of all rows is spread like any other.

Edge cases: a null text has no tokens; a source without tokens has weight 0 and is left out of epochs.
Null sources form a source.  Rows that repeat are separate documents with the same place in the order, and
the mix holds as many of them as the plan has uses.
Ties in the order are broken by doc_id and the text's hash.  Empty tables give empty results.  Extra
columns are ignored by ``mixing_plan`` and carried by ``mixed_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD_GAP, stored

SECTIONS, ROUNDS, STEEPEST = 32, 6, 1024.0


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != ""))


def source_shares(sized: DataFrame) -> DataFrame:
    """(source, total, share) of sources that have tokens."""
    totals = sized.groupBy("source").agg(F.sum("tokens").cast("double").alias("total")).filter("total > 0")
    return totals.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def _measures(shares: DataFrame, exponents: Column, budget: float | None) -> DataFrame:
    """For each exponent: entropy as a fraction of that of equal weights, and the most repeats of a source."""
    powers = shares.select("share", "total", F.explode(exponents).alias("a")).withColumn("p", F.pow("share", F.col("a")))
    summed = powers.groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.log("share")).alias("pl"), F.count("*").alias("n"), F.max(F.col("p") / F.col("total")).alias("most"), F.min(F.col("p") / F.col("total")).alias("least"))
    entropy = F.log("z") - F.col("a") * F.col("pl") / F.col("z")
    spent = F.lit(budget) if budget is not None else F.col("z") / F.col("least")  # no budget: each document at least once
    return summed.select("a", F.when(F.col("n") > 1, entropy / F.log("n")).otherwise(F.lit(0.0)).alias("entropy"), (F.col("most") / F.col("z") * spent).alias("repeats"))


def _within(target_entropy: float | None, max_repeats: float | None) -> Column:
    ok = F.lit(True)
    if target_entropy is not None:
        ok = ok & (F.col("entropy") <= target_entropy)
    if max_repeats is not None:
        ok = ok & (F.col("repeats") <= max_repeats)
    return ok


def find_exponent(shares: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> float:
    """The smallest exponent that keeps both limits: looked for in [0, 1], then, for an entropy below that of the shares,
    in [1, 2], [2, 4] and so on up to ``STEEPEST``; 1, the shares themselves, where none does."""
    low, high, found = 0.0, 1.0, False
    for _ in range(ROUNDS + math.ceil(math.log2(STEEPEST))):
        step = (high - low) / SECTIONS
        grid = F.transform(F.sequence(F.lit(0), F.lit(SECTIONS)), lambda i: F.lit(low) + i * F.lit(step))
        best = _measures(shares, grid, budget).filter(_within(target_entropy, max_repeats)).agg(F.min("a")).first()[0]
        if best is None:
            if found or high >= STEEPEST:
                break
            low, high = high, 2 * high
            continue
        low, high, found = max(low, best - step), best, True
        if low == high or step < 1e-8:
            break
    return high if found else 1.0


def entropy_of(shares: DataFrame) -> float:
    """The shares' own entropy, as a fraction of that of equal weights."""
    return _measures(shares, F.array(F.lit(1.0)), None).first().entropy


def mixing_weights(shares: DataFrame, exponent: float, budget: float | None) -> DataFrame:
    """(source, total, share, weight, spend): ``spend`` is the source's budget in tokens."""
    p = F.pow("share", F.lit(exponent))
    everyone = Window.partitionBy()  # one row a source
    weight = shares.withColumn("weight", p / F.sum(p).over(everyone))
    whole = F.lit(budget) if budget is not None else F.max(F.col("total") / F.col("weight")).over(everyone)
    return weight.withColumn("spend", F.col("weight") * whole)


def mixing_plan(docs: DataFrame, budget: float | None = None, target_entropy: float | None = 0.98, max_repeats: float | None = 4.0, block_tokens: int = 1_000_000, seed: int = 17, budget_share: float | None = 1.0, slot_rows: int = 2000, keep_gap: float | None = None) -> DataFrame:
    """doc_id, print, source, epoch, tokens, block, place, weight, share, met: a row for each use of a document.

    ``budget`` tokens are spent, or ``budget_share`` of all tokens; with neither, the least that uses
    every document at least once.  ``keep_gap`` sets the target by the table: of what the shares' entropy lacks to that of
    equal weights, so large a part stays.  ``met`` is false where no exponent keeps the limits; the weights are the shares then.
    """
    sized = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), token_count(F.col("text")).alias("tokens"))
    return _plan(sized, budget, target_entropy, max_repeats, block_tokens, seed, budget_share, slot_rows, keep_gap)


def _plan(sized: DataFrame, budget: float | None, target_entropy: float | None, max_repeats: float | None, block_tokens: int, seed: int, budget_share: float | None, slot_rows: int, keep_gap: float | None) -> DataFrame:
    sized = stored(sized, "mix-sizes")
    shares = stored(source_shares(sized), "mix-shares")
    seen = shares.agg(F.sum("total").alias("tokens")).first()
    if seen.tokens is None:
        kinds = {f.name: f.dataType.simpleString() for f in sized.schema}
        schema = f"doc_id {kinds['doc_id']}, print bigint, source string, epoch int, tokens int, block bigint, place int, weight double, share double, met boolean"
        return sized.sparkSession.createDataFrame([], schema)
    if budget is None and budget_share is not None:
        budget = float(seen.tokens * budget_share)
    if keep_gap is not None:
        target_entropy = 1 - keep_gap * (1 - entropy_of(shares))
    exponent = find_exponent(shares, budget, target_entropy, max_repeats)
    met = not _measures(shares, F.array(F.lit(exponent)), budget).filter(_within(target_entropy, max_repeats)).isEmpty()
    weights = stored(mixing_weights(shares, exponent, budget), "mix-weights")
    spend = weights.agg(F.sum("spend")).first()[0]
    blocks = max(1, math.ceil(spend / block_tokens))
    bits = min(40, max(2, math.ceil(math.log2(max(1, sized.count()) / slot_rows + 1))))

    w = weights.select(F.col("source").alias("s"), "total", "weight", "share", "spend")
    uses = sized.filter("tokens > 0").join(w, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.ceil(F.col("spend") / F.col("total") - 1e-9).cast("int")
    uses = uses.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    key = F.xxhash64(F.lit(seed), "source", "epoch", "doc_id", "print")
    uses = uses.withColumn("key", key).withColumn("slot", F.shiftrightunsigned("key", 64 - bits))

    stream = Window.partitionBy("source", "epoch").orderBy("slot")
    slots = uses.groupBy("source", "epoch", "slot").agg(F.sum("tokens").alias("sum"))
    slots = stored(slots.select("source", "epoch", "slot", (F.sum("sum").over(stream) - F.col("sum")).alias("before")), "mix-slots")
    u, o = uses.alias("u"), slots.hint("shuffle_merge").alias("o")
    placed = u.join(o, F.col("u.source").eqNullSafe(F.col("o.source")) & (F.col("u.epoch") == F.col("o.epoch")) & (F.col("u.slot") == F.col("o.slot"))).select("u.*", "before")
    inside = Window.partitionBy("source", "epoch", "slot").orderBy("key", "doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("epoch") * F.col("total") + F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    placed = placed.withColumn("start", start).filter(F.col("start") < F.col("spend"))
    block = F.least(F.lit(blocks - 1), F.floor(F.col("start") / F.col("spend") * blocks)).cast("bigint")
    placed = placed.withColumn("block", block)
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "block", "key"), "doc_id", "epoch")
    return placed.select("doc_id", "print", "source", "epoch", "tokens", "block", F.row_number().over(order).alias("place"), "weight", "share", F.lit(met).alias("met"))


def mixed_documents(docs: DataFrame, budget: float | None = None, target_entropy: float | None = 0.98, max_repeats: float | None = 4.0, block_tokens: int = 1_000_000, seed: int = 17, budget_share: float | None = 1.0, slot_rows: int = 2000, keep_gap: float | None = None) -> DataFrame:
    """The documents of the mix: the columns of ``docs``, a row for each use in the plan.

    A row is named by two hashes of all its columns, so rows of one name are the same row, and one of them stands for
    all their uses; it is looked for among rows that repeat only.  Rows travel as one column: no name of theirs can
    clash with another."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    names = [F.xxhash64(F.lit(k), *columns).alias(n) for k, n in enumerate("pq")]
    rows = docs.select(F.struct("*").alias("row"), *names)
    sized = docs.select(F.xxhash64(F.lit(0), *columns).alias("p"), F.xxhash64(F.lit(1), *columns).alias("q"), F.col("source").cast("string").alias("source"), token_count(F.col("text")).alias("tokens"))
    plan = _plan(sized.select(F.struct("p", "q").alias("doc_id"), "source", F.col("p").alias("print"), "tokens"), budget, target_entropy, max_repeats, block_tokens, seed, budget_share, slot_rows, keep_gap)
    uses = plan.groupBy("doc_id.p", "doc_id.q").agg(F.count("*").cast("int").alias("uses"))
    each = sized.groupBy("p", "q").agg(F.count("*").alias("rows"))
    found = stored(uses.join(each.hint("shuffle_merge"), ["p", "q"]), "mix-uses")
    once = rows.join(found.filter("rows = 1").hint("shuffle_merge"), ["p", "q"])
    again = rows.join(found.filter("rows > 1").hint("shuffle_merge"), ["p", "q"]).dropDuplicates(["p", "q"])
    return once.select("row", "uses").union(again.select("row", "uses")).withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses")))).select("row.*")
