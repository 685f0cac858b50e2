"""Helpers that several operators use: shared scratch tables, table access, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of all contracts: ``[^\x20\x09-\x0D]+`` is a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = "[\\x20\\x09-\\x0D]+"

_OTHER_SPACE = re.compile(r"[^\S \t\n\x0b\x0c\r]")
_WORDS = re.compile(r"[^\x20\x09-\x0d]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Words between ASCII white space.  str.split() also cuts at other Unicode spaces and at
    \\x1c-\\x1f, so it is used only where the text has none of them."""
    if _OTHER_SPACE.search(text):
        return _WORDS.findall(text)
    return text.split()


def lower_ascii(text: str) -> str:
    """Lower-case A-Z only."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, one of this machine's, which only
    a local session may use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage so that a lost executor costs
    a re-read, and gives later joins a true size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote, once nothing reads them any more; other files,
    those outside the shared folder, stay."""
    spark = df.sparkSession
    new_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    plain = lambda name: new_path(name).toUri().getPath().rstrip("/")
    root = plain(scratch_root(spark))
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if plain(folder).startswith(root + "/"):
            path = new_path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(column: str = "doc_id"):
    """crc32 of the id's decimal text, mod 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3
