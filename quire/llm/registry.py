"""The opN_<name> queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, quality_rules
from ._shared import crc_fold, scratch_path, table


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudo_likelihood import pseudo_likelihoods

    return pseudo_likelihoods(table(spark, sf_dir, "documents"))


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train_filters

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_fold() == 1, F.lit(False))
    return identify(docs, train_filters(docs.filter(~held_out)), held_out)


def op3_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import describe_token_files, write_token_files

    out = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out)
    return describe_token_files(spark, out)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import without_repeated_lines

    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op6_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe_roundtrip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), size=2)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixing_plan

    # half of the way to equal weights, no source repeated over four times as often as another, no document left out
    plan = mixing_plan(table(spark, sf_dir, "documents"), budget_share=None, target_entropy=None, keep_gap=0.5, max_repeats=4.0)
    return plan.select("doc_id", "source", "epoch", "tokens", "block", "place", F.round("weight", 9).alias("weight"), F.round("share", 9).alias("share"), "met")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op11_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of = (op1_pseudo_likelihood, op2_language_filters, op3_orc_token_files, op4_personal_data, op5_line_dedup, op6_bpe_roundtrip, op7_quality_rules, op8_minhash_groups, op9_source_mixing, op10_exact_dedup, op11_simhash_groups, op12_divergence_audit, op13_embedding_whitening)
    return {f.__name__: f for f in all_of}


#: The same rows in DuckDB; the two engines lower-case A-Z alike through translate().
EXACT_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""

#: Word pairs as sets; links between distinct sets only, components by a recursive walk.
NEAR_GROUPS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_sort(list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) END AS g FROM d),
c AS (SELECT g, min(doc_id) AS v, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT v, n, unnest(g) AS x FROM c),
p AS (SELECT a.v AS a, b.v AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.v < b.v
      AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.v, b.v),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk AS (SELECT v AS a, v AS b FROM c UNION SELECT w.a, x.b FROM walk w JOIN sym x ON w.b = x.a),
r AS (SELECT a AS v, min(b) AS root FROM walk GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(r.root, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.g = c.g AND len(s.g) > 0 LEFT JOIN r ON r.v = c.v
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.ORACLE_SQL, "op8_minhash_groups": NEAR_GROUPS_SQL, "op10_exact_dedup": EXACT_DEDUP_SQL, "op12_divergence_audit": divergence.ORACLE_SQL}
