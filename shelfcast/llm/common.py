"""Shared helpers: shared-folder tables, Arrow batches, hashing of words."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents and bytes in one Arrow batch, at most: what a Python worker holds at
#: once. A single text above the bytes is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 32 * 2**20
#: Words kept in a worker's cache before it starts anew, so memory is bounded.
CACHE_WORDS = 400_000

_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small.

    On a cluster the package is shipped with ``--py-files``; where driver and
    workers share a file system the path below is enough. The rows are
    only ever lowered and the bytes set only where nobody has; plans read both
    when they run, so they stay for the session.
    """
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if _HOME not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, _HOME) if x)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session in one process (unit tests) gets a folder of its
    own; on a cluster no folder can be guessed that all machines see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="shelfcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage: a lost executor costs only the tasks that read its output,
    not what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfcast/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for root in roots:
        if "/shelfcast/" in root:
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def reducers(spark: SparkSession) -> int:
    """Reduce-side parallelism the session is sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def first_by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The first ``rows`` rows by a hash of ``keys``.

    A count sets a bar a little above what is wanted, so only about that many
    rows, not that many from every partition, meet in the task that cuts them.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 31))
    n = df.count()
    if n > 2 * rows:
        df = df.filter(place < int(1.3 * rows / n * 2**31) + 1000)
    return df.orderBy(place, *keys).limit(rows)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` column names, lengthened where ``df`` has them already."""
    there = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


def dealt(keys: np.ndarray, n: int) -> np.ndarray:
    """Task of 0 .. n-1 for each key: a mixed hash of the key, modulo n."""
    h = keys.astype(np.uint64) * BASE
    h ^= h >> np.uint64(32)
    return (h % np.uint64(n)).astype(np.int32)


def runs_of(at: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, stop) of each run of equal values."""
    if not len(at):
        return []
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]).tolist()
    return [(int(at[lo]), lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_schema(spec: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(spec) if isinstance(spec, str) else spec)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; misses are computed and kept, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashed(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the rolling hash, of a second one, and of the finishing mix.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_2 = np.uint64(0xD6E8FEB86659FD93)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= MIX
    return h ^ (h >> np.uint64(31))


def rolling(x: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` values, modulo 2**64.

    The polynomial of a window is put together from those of its power-of-two
    parts, so a window costs log2(width) multiplications. Position i of the
    result belongs to the window that starts at i.
    """
    if len(x) < width:
        return np.empty(0, np.uint64)
    part, size, power = x, 1, int(base)
    out, done = None, 0
    while True:
        if width & size:
            if out is None:
                out = part
            else:
                m = len(part) - done
                out = out[:m] * np.uint64(power) + part[done:]
            done += size
        if done == width:
            return mixed(out)
        part = part[:-size] * np.uint64(power) + part[size:]
        power = power * power % 2**64
        size *= 2
