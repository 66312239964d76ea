"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in one process gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shelfcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where driver and workers share a file
    system; a cluster gets it with ``--py-files``. Arrow batches are bounded in bytes."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _HOME not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, _HOME) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 * 2**20))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again: a table that several branches read.

    Each call writes anew, so nothing outlives a change of the inputs, and other
    queries of the session plan as if it were not there. The files go with the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing reads any more."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables/" in root:
            removed(df.sparkSession, root)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path as it is named there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder, in order."""
    fs, p = place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def text_of(spark: SparkSession, path: str) -> str | None:
    """What a small text file holds; None if it is not there."""
    fs, p = place(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r.value for r in spark.read.option("wholetext", "true").text(path).collect())


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write ``text`` beside ``path`` and rename it over it: readers see the old or the new."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, there = place(spark, path)
    draft = jvm.org.apache.hadoop.fs.Path(there.getParent(), f".{there.getName()}-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), conf).rename(draft, there, options)
