"""Content-addressed stages: run one only if what it depends on has changed.

Stages keep tables or reports in any file system that Spark reaches: files are digested
by tasks, each build is a version of its own, and a pointer file, replaced in
one step, says which version holds.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources.shared import place, removed, replace_text, text_of

VERSION = 2
#: Bytes of a file up to which it is one value of a task; larger ones are split.
LARGE = 256 * 2**20


def file_digest(path: str) -> str:
    """SHA-256 of a file of code."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@dataclass(frozen=True)
class Outcome:
    hit: bool
    metadata: dict
    #: The version that holds.
    path: str


def table_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """A digest of each data file below ``path`` by its place there, made by tasks.

    SHA-256; of a file over LARGE, which many tasks share, its length and the sum of a
    hash of each line with its place (its block and its rank there). Empty if there is nothing.
    """
    fs, p = place(spark, path)
    if not fs.exists(p):
        return {}
    base = p.toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    at = F.substring_index("path", base, -1).alias("place")
    out = {r.place: r.digest for r in files.filter(F.col("length") <= LARGE).select(at, F.sha2("content", 256).alias("digest")).collect()}
    large = {r.place: (r.path, r.length) for r in files.filter(F.col("length") > LARGE).select(at, "path", "length").collect()}
    for name, (full, length) in large.items():
        lines = spark.read.option("lineSep", "\n").text(full)
        rank = F.monotonically_increasing_id().bitwiseAND(2**33 - 1)
        total = lines.select(F.xxhash64("value", "_metadata.file_block_start", rank).cast("decimal(38,0)").alias("h")).agg(F.sum("h")).first()[0]
        out[name] = f"{length}-{total}"
    return out


def fingerprint(stage: str, inputs: list[tuple[str, dict]], code: list[str], parameters: dict) -> str:
    """``inputs`` are paths with the digests of their files; ``code`` is local files."""
    # code is named by its place below the folder that all of it shares: base names repeat
    root = os.path.commonpath([os.path.dirname(os.path.abspath(p)) for p in code]) if code else ""
    named = {os.path.relpath(os.path.abspath(p), root): file_digest(p) for p in sorted(code)}
    told = {"version": VERSION, "stage": stage, "inputs": dict(inputs), "code": named, "parameters": parameters}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def run_stage(spark: SparkSession, stage: str, root: str, inputs: list[str], code: list[str], parameters: dict, build: Callable[[str], dict], force: bool = False) -> Outcome:
    """Build a table below ``root`` unless the pointer there vouches for one.

    ``build`` writes to the path it is given and returns facts about it. A hit
    needs the same inputs, code and parameters, and the files that were written. A run that
    ends before the pointer is replaced leaves the version that held; what it
    wrote is never read. The version before goes after the pointer is replaced, so a reader of it has to start anew.
    """
    mark = fingerprint(stage, [(p, table_digests(spark, p)) for p in sorted(inputs)], code, parameters)
    pointer = f"{root}/current.json"
    known = json.loads(text_of(spark, pointer) or "{}")
    if not force and known.get("fingerprint") == mark and known["digests"] == table_digests(spark, known["path"]) != {}:
        return Outcome(True, known["metadata"], known["path"])
    path = f"{root}/{stage}-{uuid.uuid4().hex}"
    metadata = build(path) or {}
    digests = table_digests(spark, path)
    if not digests:
        raise RuntimeError(f"stage {stage} produced nothing")
    replace_text(spark, pointer, json.dumps({"fingerprint": mark, "path": path, "digests": digests, "stage": stage, "metadata": metadata}, sort_keys=True, default=str))
    if known:
        removed(spark, known["path"])
    return Outcome(False, metadata, path)


def current(spark: SparkSession, root: str) -> str:
    """Where the version below ``root`` is that holds."""
    found = text_of(spark, f"{root}/current.json")
    if found is None:
        raise FileNotFoundError(f"{root} has not been built")
    return json.loads(found)["path"]
