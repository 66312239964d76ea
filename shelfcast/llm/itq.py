"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations are learned so that the signs of rotated vectors lose little and are
balanced. Their bits fill a row of tables; vectors equal in one table are
candidates if their 128-bit codes are near in Hamming distance. Every candidate
pair is decided on the original vectors in double precision, so no link below the
threshold is reported, and only links join components.

Layout for scale
  * The rotations are fitted on a bounded sample; every vector is indexed.
    Codes are taken about the origin, as the cosine is: about a mean, close
    vectors on either side of it would get opposite bits.
  * A table key has about log2(n) bits, so a bucket has a few chance members,
    and the number of tables is the smallest whose measured recall at the
    threshold reaches the target (pairs at exactly that cosine, made from the half
    of the sample that no rotation was learned on). It grows as a small power of n.
  * Equal vectors fall together first. Large buckets are compared block by block
    by many tasks. Pairs are told only where a vector has few near ones in a
    bucket; a crowd of near copies is told by one edge a row, and decided in
    blocks (see graph.py). A chain of vectors below the threshold costs its
    neighbours, however long it is.
  * Codes move once a table; vectors move to their pairs or blocks.

Defined results
  Vectors that are null, empty, zero, or hold null or non-finite components
  link with nothing. Vectors link only with vectors of their own length. Rows
  with a null id are left out; of rows that repeat an id the smallest vector (by
  hash) stands. A cosine of the threshold itself, as double precision has it, is a
  link. An empty table gives no rows. Columns besides vec_id and embedding are
  ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, prepare, stored
from .graph import candidates, exact_links

THRESHOLD, RECALL = 0.9, 0.97
#: Vectors the rotations are learned on, at most: the first by a hash of the id.
SAMPLE = 4096
#: Bits of the code compared before vectors are, and tables at most.
CODE, TABLES = 128, 512
SEED = 7


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Orthogonal rotation of rows of ``x`` that is close to its signs."""
    d = x.shape[1]
    r = np.linalg.qr(rng.normal(size=(d, d)))[0]
    for _ in range(rounds):
        signs = np.where(x @ r >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(x.T @ signs)
        r = u @ vt
    return r


@dataclass(frozen=True)
class Coder:
    """Codes of unit vectors of one length."""

    rotations: np.ndarray
    tables: int
    bits: int
    #: Largest Hamming distance of CODE bits at which a pair is a candidate.
    near: int

    def signs(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ r >= 0 for r in self.rotations], axis=1)

    def keys(self, bits: np.ndarray) -> np.ndarray:
        used = bits[:, : self.tables * self.bits].reshape(len(bits), self.tables, self.bits)
        return (used.astype(np.int64) << np.arange(self.bits)).sum(axis=2)

    def code(self, bits: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.packbits(bits[:, :CODE], axis=1)).view("<i8")


def make_coder(x: np.ndarray, n: int, threshold: float, recall: float) -> Coder:
    """Learn rotations on one half of the unit vectors ``x`` and fit the tables to n vectors.

    The recall is measured on the other half: signs of the vectors that a rotation
    was learned on change less than those of others.
    """
    rng = np.random.default_rng(SEED)
    x, unseen = (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    d = x.shape[1]
    s = int(min(30, max(8, round(math.log2(max(n, 2))))))
    # pairs at the threshold itself: the hardest that must be found
    base = unseen[rng.integers(0, len(unseen), 4000)]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-12)
    other = threshold * base + math.sqrt(1 - threshold**2) * side
    rotations: list[np.ndarray] = []
    tables, found = 0, np.zeros(len(base), bool)
    a, b = np.empty((len(base), 0), bool), np.empty((len(base), 0), bool)
    while True:
        r = learn_rotation(x, rng)
        rotations.append(r)
        a, b = (np.concatenate([m, y @ r >= 0], axis=1) for m, y in ((a, base), (b, other)))
        while (tables + 1) * s <= a.shape[1] and found.mean() < recall and tables < TABLES:
            found |= (a[:, tables * s : (tables + 1) * s] == b[:, tables * s : (tables + 1) * s]).all(axis=1)
            tables += 1
        if tables >= TABLES and found.mean() < recall:
            # shorter keys agree more often; those of a few bits always do
            if s == 1:
                raise RuntimeError(f"{TABLES} tables find {found.mean():.3f} of the pairs at the threshold, not {recall}")
            s, tables = s - 1, 0
            found[:] = False
        elif found.mean() >= recall and a.shape[1] >= CODE:
            break
    apart = (a[:, :CODE] != b[:, :CODE]).sum(axis=1)
    return Coder(np.array(rotations), tables, s, int(np.quantile(apart, 0.999)))


def _units(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for vectors that link with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        if not v.is_valid or v.values.null_count or not len(v.values):
            out.append(None)
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top  # so squares neither overflow nor vanish
        out.append(x / np.sqrt((x * x).sum()))
    return out


_CODED = "vec_id long, dim int, vec_key binary, code0 long, code1 long, keys array<long>"


def _coder(coders: dict[int, Coder]):
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            units = _units(batch.column(1))
            rows: list[tuple] = [(i, None, None, None, None, None) for i, u in zip(ids, units, strict=True) if u is None]
            for d, c in coders.items():
                own = [(i, u) for i, u in zip(ids, units, strict=True) if u is not None and len(u) == d]
                if own:
                    x = np.array([u for _, u in own])
                    bits = c.signs(x)
                    code = c.code(bits)
                    rows += zip([i for i, _ in own], [d] * len(own), [xxhash.xxh3_128_digest(u.tobytes()) for _, u in own], code[:, 0].tolist(), code[:, 1].tolist(), c.keys(bits).tolist(), strict=True)
            if rows:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _CODED.split(", ")])

    return run


def _near(coders: dict[int, Coder]):
    def near(table: pa.Table):
        # bits are counted of unsigned numbers: of a negative one numpy counts those of its size
        c0, c1 = (table.column(c).to_numpy().view(np.uint64) for c in ("code0", "code1"))
        dim = table.column("dim").to_numpy()
        limit = np.array([coders[d].near for d in dim.tolist()])

        def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            apart = np.bitwise_count(c0[a] ^ c0[b]).astype(np.int64) + np.bitwise_count(c1[a] ^ c1[b])
            return (dim[a] == dim[b]) & (apart <= limit[a])

        return of

    return near


class _Cosine:
    def __init__(self, table: pa.Table, threshold: float):
        units = _units(table.column("embedding"))
        width = max(map(len, units), default=0)
        self.x = np.zeros((len(units), width))
        self.dim = np.array([len(u) for u in units])
        for k, u in enumerate(units):
            self.x[k, : len(u)] = u
        self.threshold = threshold

    def links(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.x[x] @ self.x[y].T >= self.threshold) & (self.dim[x][:, None] == self.dim[y])


def _paired(threshold: float):
    def of(one: pa.Table, other: pa.Table) -> np.ndarray:
        a, b = _units(one.column("embedding")), _units(other.column("embedding"))
        return np.array([len(x) == len(y) and float(x @ y) >= threshold for x, y in zip(a, b, strict=True)], bool)

    return of


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vec_id: n_links, component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    prepare(spark)
    source = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.xxhash64("embedding").alias("hash"))
    sizes = {r.d: r.n for r in source.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).collect()}
    coders = {}
    for d, n in sizes.items():
        picked = first_by_hash(source.filter(F.size("embedding") == d), SAMPLE, "vec_id", "hash").select("embedding").toArrow()
        units = [u for u in _units(picked.column(0)) if u is not None]
        if units:
            coders[d] = make_coder(np.array(units), n, threshold, recall)
    # of rows that repeat an id one stands
    one = source.groupBy("vec_id").agg(F.min(F.struct("hash", "embedding")).alias("m")).select("vec_id", "m.embedding")
    coded = stored(one.mapInArrow(_coder(coders), _CODED), "coded")
    classes = stored(coded.filter("vec_key is not null").groupBy("vec_key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    reps = coded.join(classes.select("rep"), coded.vec_id == F.col("rep"), "left_semi")
    reps = stored(reps.select(F.col("vec_id").alias("node"), "dim", "code0", "code1", "keys"), "reps")
    rows = reps.select("node", "dim", F.posexplode("keys").alias("t", "key")).select("node", F.xxhash64("dim", "t", "key").alias("bucket"))
    crowds, pairs = candidates(rows, reps.drop("keys"), _near(coders), "tables")
    wanted = stored(crowds.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    members = classes.select(F.col("rep").alias("node"), F.col("copies").alias("weight")).join(wanted, "node").join(one.withColumnRenamed("vec_id", "node"), "node")
    links, joined = exact_links(crowds, pairs, stored(members, "members"), lambda t: _Cosine(t, threshold), _paired(threshold), "cosines")
    told = links.join(joined.groupBy("node").agg(F.min("root").alias("root")), "node", "left")
    out = classes.join(told, classes.rep == told.node, "left").select("vec_key", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (
        coded.select("vec_id", "vec_key")
        .join(out, "vec_key", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
