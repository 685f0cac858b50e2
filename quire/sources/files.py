"""Reading works, lexicons and pronunciations from files, and checking lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """One work for each .txt file: title is the file's stem, poet its folder; line ends become LF."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.col("_metadata.file_path").alias("p"))
    parts = F.split(F.url_decode("p"), "/")
    title, poet = F.regexp_replace(F.element_at(parts, -1), "\\.txt$", ""), F.element_at(parts, -2)
    return files.select(F.concat_ws("/", poet, title).alias("work_id"), poet.alias("poet"), title.alias("title"), F.regexp_replace("value", "\\r\\n?", "\n").alias("text"))


def scan_vad_tsv(spark: SparkSession, path: str, header: bool) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=header, schema="term string, valence double, arousal double, dominance double", mode="PERMISSIVE")


def scan_norm_table(spark: SparkSession, path: str, schema: str, missing: str = "#N/A") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue=missing)


def scan_pronunciation(spark: SparkSession, path: str) -> DataFrame:
    """lookup_form, variant, phones, stress, syllables from lines ``WORD(n) P H O N E S # comment``."""
    rows = spark.read.text(path).filter("value not rlike '^(;;;|\\\\s*$)'").select(F.regexp_replace("value", "\\s*#.*$", "").alias("v"))
    head, variant = F.regexp_extract("v", "^(\\S+?)(?:\\((\\d+)\\))?\\s", 1), F.regexp_extract("v", "^(\\S+?)(?:\\((\\d+)\\))?\\s", 2)
    phones = F.filter(F.split(F.regexp_replace("v", "^\\S+\\s+", ""), "\\s+"), lambda p: p != "")
    vowels = F.filter("phones", lambda p: p.rlike("[012]$"))
    rows = rows.select(F.lower(head).alias("lookup_form"), F.when(variant == "", 1).otherwise(variant.cast("int") + 1).alias("variant"), phones.alias("phones"))
    return rows.withColumn("stress", F.array_join(F.transform(vowels, lambda p: F.right(p, F.lit(1))), "")).withColumn("syllables", F.size(vowels))


def regroup_emotions(rows: DataFrame) -> DataFrame:
    """(lookup_form, associations, rows): categories whose flag is 1."""
    return rows.groupBy("lookup_form").agg(F.sort_array(F.collect_list(F.when(F.col("flag") == 1, F.col("category")))).alias("associations"), F.count("*").alias("rows"))


def regroup_intensities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lookup_form").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "value")))).alias("intensities"))


def lexicon_validation(rows: DataFrame, low: float, high: float) -> DataFrame:
    """QC counts of (lexicon, term, value)."""
    keyed = rows.withColumn("key", F.lower(F.trim("term")))
    per_key = keyed.groupBy("lexicon", "key").agg(F.count("*").alias("n"), F.countDistinct("term").alias("spellings"), F.count_if(F.col("key") == "").alias("blank"), F.count_if(F.col("value").isNull()).alias("malformed"), F.count_if((F.col("value") < low) | (F.col("value") > high)).alias("outside"), F.max(F.col("key").contains(" ").cast("int")).alias("phrase"))
    return per_key.groupBy("lexicon").agg(F.sum("n").alias("total"), F.count("*").alias("entries"), F.sum("blank").alias("blank"), F.sum("malformed").alias("malformed"), F.sum("outside").alias("out_of_range"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), F.count_if(F.col("spellings") > 1).alias("case_collisions"), F.sum("phrase").alias("phrases"))


def lexicon_normalise(rows: DataFrame, low: float, high: float) -> DataFrame:
    return rows.withColumn("normalized", (F.col("value") - low) / (high - low))


def collision_groups(rows: DataFrame) -> DataFrame:
    """Keys whose source terms differ only by case."""
    return rows.groupBy("lexicon", F.lower("term").alias("lookup_form")).agg(F.countDistinct("term").alias("spellings")).filter("spellings > 1")


def scan_vad_csv(spark: SparkSession, path: str) -> DataFrame:
    """Means, spreads and numbers of raters from a CSV with dotted names: ``Word``, then ``V.Mean``, ``V.SD``, ``V.Rat`` and so on."""
    raw = spark.read.csv(path, header=True)
    names = {"V": "valence", "A": "arousal", "D": "dominance"}
    parts = [F.col(f"`{k}.{part}`").cast(kind).alias(name + end) for k, name in names.items() for part, end, kind in (("Mean", "", "double"), ("SD", "_sd", "double"), ("Rat", "_raters", "int"))]
    return raw.select(F.lower(F.trim("Word")).alias("term"), *parts)


def scan_emotion_tsv(spark: SparkSession, path: str, categories: int) -> DataFrame:
    """lookup_form, associations from rows term, category, 0 or 1; terms that lack a category are left out."""
    rows = spark.read.csv(path, sep="\t", schema="lookup_form string, category string, flag int")
    return regroup_emotions(rows).filter(F.col("rows") == categories)


def scan_intensity_tsv(spark: SparkSession, path: str) -> DataFrame:
    """lookup_form, intensities (map) from rows term, category, score."""
    return regroup_intensities(spark.read.csv(path, sep="\t", schema="lookup_form string, category string, value double"))
