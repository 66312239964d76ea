"""A table of immutable shards with size-tiered compaction and versioned manifests.

Layout of a store's folder
  shards/<write>/part-*.parquet   written once, never changed
  manifest/v00000007.json         what version 7 consists of

An arrival is written as small shards and committed as the next version. A
compaction groups shards into tiers by size, each FANOUT times the one below,
and merges runs of neighbours of a tier, oldest first, into files of about the
target size; the merged files replace them in the next version. A version
exists once its manifest has been renamed into place, and a rename onto an
existing version fails, so a lost executor, a crashed driver or a second writer
leaves the last committed version whole. That needs a store whose rename is
atomic and refuses to overwrite, as HDFS and local file systems do; on an object
store a committer with a conditional put has to take its place. A writer that
loses the race lays its change over the version that won and tries again; its
data files are written once. Files that no kept version names, those of writes
that never were committed too, are removed by ``vacuum`` once they are old enough
that no writer can still be about to commit them.

The driver handles manifests only: one entry a file. Data move from file to file
without a shuffle, one task a merged file.

Defined results
  Rows are kept as they are, with nulls, repeats and all columns. An empty
  arrival makes a version without new shards. An arrival with other columns
  than the store's is refused. A shard above half the target is left alone. Texts
  of any length, ties and repeats are rows like others; no column names are taken.
"""

from __future__ import annotations

import json
import math
import re
import time
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT, TARGET_BYTES = 4, 128 * 2**20
#: Sizes below this are one tier. Merged files written by one job.
LOWEST_BYTES, MERGES_A_JOB = 2**20, 256


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    #: Version that first named the shard; merges keep the oldest of their parts.
    born: int


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def tier(size: int, lowest: int = LOWEST_BYTES, fanout: int = FANOUT) -> int:
    return 0 if size <= lowest else 1 + int(math.log(size / lowest, fanout))


def merges(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT, everything: bool = False) -> list[list[Shard]]:
    """Runs to merge: neighbours of one tier, FANOUT of them at least.

    A run ends when it reaches ``target``. ``everything`` also merges shorter
    runs and those of different tiers, as before an export.
    """
    by_tier: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.born, s.path)):
        if s.bytes <= target // 2:
            by_tier.setdefault(0 if everything else tier(s.bytes, fanout=fanout), []).append(s)
    out = []
    for _, some in sorted(by_tier.items()):
        run: list[Shard] = []
        for s in some:
            if run and sum(x.bytes for x in run) + s.bytes > target:
                out.append(run)
                run = []
            run.append(s)
        out.append(run)
    return [r for r in out if len(r) >= (2 if everything else fanout) or len(r) > 1 and sum(s.bytes for s in r) >= target // 2]


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- files, through Hadoop: the store may be where only Spark reads

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def _commit(self, version: int, manifest: dict) -> None:
        fs, final = self._fs(), f"{self.root}/manifest/v{version:08d}.json"
        draft = f"{self.root}/manifest/.draft-{uuid.uuid4().hex}"
        out = fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        plain = self.spark.sparkContext._gateway.new_array(options, 1)
        plain[0] = options.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        try:
            context.rename(self._path(draft), self._path(final), plain)
        except Exception as e:
            fs.delete(self._path(draft), False)
            if fs.exists(self._path(final)):
                raise Conflict(f"version {version} is committed already") from e
            raise

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.root}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest; of an empty store, version 0 without shards."""
        there = self.versions()
        if version is None:
            if not there:
                return {"version": 0, "schema": None, "shards": []}
            version = there[-1]
        source = self._fs().open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    # -- data

    def _written(self, df: DataFrame, born: dict[str, int] | int) -> list[Shard]:
        """Write ``df`` into a folder of its own; tell its files with rows."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(folder)
        files = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).agg(F.count("*").alias("n")).collect()
        return [Shard(unquote(r.p), r.b, r.n, born) for r in sorted(files, key=lambda r: r.p)]

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df`` as small shards; returns the new version."""
        schema = json.loads(df.schema.json())
        fields = [(f["name"], f["type"]) for f in schema["fields"]]
        new: list[Shard] | None = None
        while True:
            now = self.manifest()
            if now["schema"] and fields != [(f["name"], f["type"]) for f in now["schema"]["fields"]]:
                raise ValueError("the columns differ from the store's")
            version = now["version"] + 1
            new = self._written(df, version) if new is None else [replace(s, born=version) for s in new]
            try:
                self._commit(version, {"version": version, "schema": schema, "shards": now["shards"] + [asdict(s) for s in new]})
            except Conflict:
                continue  # on top of the version that was first
            return version

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, everything: bool = False) -> int:
        """Merge until no tier has a run to merge; returns the version."""
        while True:
            now = self.manifest()
            runs = merges([Shard(**s) for s in now["shards"]], target, fanout, everything)
            if not runs:
                return now["version"]
            schema, new = T.StructType.fromJson(now["schema"]), []
            for at in range(0, len(runs), MERGES_A_JOB):
                some = runs[at : at + MERGES_A_JOB]
                parts = [self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1) for run in some]
                new += self._written(reduce(DataFrame.unionAll, parts), min(s.born for run in some for s in run))
            gone = {s.path for run in runs for s in run}
            if sum(s.rows for s in new) != sum(s.rows for run in runs for s in run):
                raise RuntimeError("merged shards do not have the rows of their parts")
            while True:
                there = {s["path"] for s in now["shards"]}
                if not gone <= there:  # another compaction has merged some of these: plan anew
                    break
                version = now["version"] + 1
                kept = [s for s in now["shards"] if s["path"] not in gone]
                try:
                    self._commit(version, {"version": version, "schema": now["schema"], "shards": kept + [asdict(s) for s in new]})
                    break
                except Conflict:
                    now = self.manifest()

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if not m["schema"]:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(m["schema"])
        if not m["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["path"] for s in m["shards"]])

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> int:
        """Drop manifests but the last ``keep``, and files that the kept ones do not name.

        Files that an older version names go at once. Files that no version names
        may belong to a write under way: they go when older than ``hours``. The
        last version always stays. Returns the number of files removed.
        """
        keep = max(1, keep)
        there = self.versions()
        kept = {_plain(s.path) for v in there[-keep:] for s in self.shards(v)}
        named = {_plain(s.path) for v in there[:-keep] for s in self.shards(v)}
        fs, gone, folder = self._fs(), 0, self._path(f"{self.root}/shards")
        oldest = time.time() * 1000 - hours * 3_600_000
        writes = fs.listStatus(folder) if fs.exists(folder) else []
        for write in writes:
            left = 0
            for f in fs.listStatus(write.getPath()):
                path = _plain(f.getPath().toString())
                data = path.endswith(".parquet")
                if path not in kept and data and (path in named or f.getModificationTime() <= oldest):
                    gone += fs.delete(f.getPath(), False)
                else:
                    left += data
            if not left and write.getModificationTime() <= oldest:
                fs.delete(write.getPath(), True)  # markers of a write all of whose shards are gone
        for v in there[:-keep]:
            fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        return gone


def _plain(path: str) -> str:
    """A path without scheme and host, as listings and readers write those differently."""
    return re.sub(r"^\w+:(//[^/]*)?", "", unquote(path))
