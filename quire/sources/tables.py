"""Derived tables written out, so that joins see their true size and lineage stays short."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: (application, name, state of the inputs) -> folder.
_KNOWN: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a session of one machine gets one where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.  Its files have a size, by which Spark broadcasts
    it in later joins or doesn't; adaptive execution splits hot keys where it is not."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state_of_inputs(df: DataFrame) -> str:
    """A digest of the folders that hold the files ``df`` reads: names, sizes and times of change."""
    spark = df.sparkSession
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = hashlib.sha256()
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        listed = jvm.org.apache.commons.lang3.ArrayUtils.toString(path.getFileSystem(hadoop).listStatus(path))
        found.update(re.sub(r"access_time=\d+", "", listed).encode())
    return found.hexdigest()


def kept(spark: SparkSession, name: str, make, source: DataFrame | None = None) -> DataFrame:
    """The table that ``make`` returns, written once a session under ``name``; anew if the files that it is made
    from have changed since, or its own have gone.  Where ``make`` does work of its own, ``source`` reads the same files."""
    made = make() if source is None else None
    key = (spark.sparkContext.applicationId, name, _state_of_inputs(made if source is None else source))
    if key in _KNOWN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_KNOWN[key] + "/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(_KNOWN[key])
    folder = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    (make() if made is None else made).write.parquet(folder)
    _KNOWN[key] = folder
    return spark.read.parquet(folder)
