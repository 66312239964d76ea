"""Filter interaction audit: what each of five filters does in every order.

Method
  A packed bitmap index. Each task packs the failures of the five filters and the
  two labels of its rows into NumPy bitsets, the rows of a part side by side, so a
  part is a stretch of each bitset. For each set of earlier filters the failures are
  joined by OR; AND-NOT and a popcount give what the next filter removes, finds gone
  already, or costs in good and toxic documents. Counts of tasks add up.

Layout for scale
  One pass over the texts leaves 40 bytes a document. Copies of a text are found by
  a 128-bit digest: counting per digest is combined before the shuffle, and the
  first of each text is joined back by (id, digest), which spreads however many copies there
  are. From there a task sends 80 rows a part; the 120 orders are spread out after that.

Defined results
  Null texts are empty ones; null sources are ''. Documents without an id are no
  copies and nothing is a copy of them; rows that repeat an id and its text aren't
  copies of each other. An id with several labels has their largest; one without
  labels, or with null ones, is neither good nor toxic. An empty table gives an
  empty one. Columns but doc_id, text and source, and in labels doc_id, quality and toxic, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, prepare, stored, words_of

C = F.col
#: Fixed values of the contract: the filters, and the bounds of the first three.
FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 200, 50, 2
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
GOOD, TOXIC = len(FILTERS), len(FILTERS) + 1
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
#: Rows packed at once, and parts whose counts a task holds, at most.
BLOCK, PARTS = 1 << 18, 4096
#: (earlier filters as bits, filter) that can meet.
STEPS = [(s, f) for s in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not s >> f & 1]


def failures(text: str | None) -> int:
    """Bits of the filters A to D that a text fails."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = words_of(text)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    signs = len(data) - len(data.translate(None, _SIGNS))
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * len(text)) << 2 | (signs > 0) << 3


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails (bits of A to D), digest of the text."""
    prepare(docs.sparkSession)
    spec = "doc_id long, part string, fails int, digest binary"
    schema = arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            digests = [blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(map(failures, texts), pa.int32()), pa.array(digests, pa.binary())], schema=schema)

    return docs.select(C("doc_id").cast("long").alias("doc_id"), F.coalesce(C("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, spec)


def indexed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits: failures of all five filters and the labels of each document."""
    rows = stored(judged(docs), "audit-rows")
    firsts = rows.filter(C("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.filter(C("doc_id").isNotNull()).groupBy(C("doc_id").cast("long").alias("doc_id")).agg(F.max((C("quality") == 1).cast("int")).alias("_good"), F.max((C("toxic") == 1).cast("int")).alias("_toxic"))
    # joined by id first: the second join needs no exchange of the rows but the first one's
    found = rows.join(marks, "doc_id", "left").join(firsts, ["doc_id", "digest"], "left")
    copy = (C("doc_id").isNotNull() & C("_first").isNull()).cast("int")
    bits = C("fails") + copy * 16 + F.coalesce("_good", F.lit(0)) * (1 << GOOD) + F.coalesce("_toxic", F.lit(0)) * (1 << TOXIC)
    return found.select("part", bits.cast("int").alias("bits"))


def counted(bits: np.ndarray) -> np.ndarray:
    """[step, count] of the documents of one part whose bits are given."""
    sets = [np.packbits((bits >> k & 1).astype(np.uint8)) for k in range(TOXIC + 1)]
    there = np.packbits(np.ones(len(bits), np.uint8))
    gone = [np.zeros_like(there)]
    for s in range(1, 1 << len(FILTERS)):
        low = (s & -s).bit_length() - 1
        gone.append(gone[s & (s - 1)] | sets[low])
    count = lambda x: int(np.bitwise_count(x).sum())
    every = (1 << len(FILTERS)) - 1
    out = np.zeros((len(STEPS), len(COUNTS)), np.int64)
    for k, (s, f) in enumerate(STEPS):
        removed = sets[f] & ~gone[s]
        out[k] = count(there & ~gone[s | 1 << f]), count(removed), count(sets[f] & gone[s]), count(sets[f] & ~gone[every ^ 1 << f]), count(removed & sets[GOOD]), count(removed & sets[TOXIC])
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each part, order and step."""
    spec = "part string, earlier int, filter int, " + ", ".join(f"{c} long" for c in COUNTS)
    schema = arrow_schema(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def pack() -> None:
            nonlocal n
            if not held:
                return
            names, bits = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            n = 0
            kinds, of = np.unique(names, return_inverse=True)
            order = np.argsort(of, kind="stable")
            for name, part in zip(kinds.tolist(), np.split(bits[order], np.cumsum(np.bincount(of))[:-1]), strict=True):
                totals[name] = totals.get(name, 0) + counted(part)

        def out() -> Iterator[pa.RecordBatch]:
            for name, counts in totals.items():
                cols = [[name] * len(STEPS), [s for s, _ in STEPS], [f for _, f in STEPS], *counts.T]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)
            totals.clear()

        for batch in batches:
            held.append((np.array(batch.column("part").to_pylist(), object), batch.column("bits").to_numpy()))
            n += batch.num_rows
            if n >= BLOCK:
                pack()
                if len(totals) > PARTS:
                    yield from out()
        pack()
        yield from out()

    spark = docs.sparkSession
    steps = indexed(docs, labels).mapInArrow(run, spec).groupBy("part", "earlier", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS])
    # of the orders of all filters, those in which exactly these stand before this one
    ways = [factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    weight = F.element_at(F.array(*map(F.lit, ways)), F.bit_count("earlier").cast("int") + 1)
    mine = F.struct("earlier", *COUNTS)
    filters = steps.groupBy("part", "filter").agg(F.sum(weight * C("removed")).cast("long").alias("shapley"), F.collect_list(mine).alias("_s"))
    steps = filters.select("part", "filter", "shapley", F.explode("_s").alias("_s")).select("part", "filter", "shapley", "_s.*")
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), k + 1, before, f))
            before |= 1 << f
    orders = spark.createDataFrame(rows, "filter_order string, step int, earlier int, filter int")
    return steps.join(F.broadcast(orders), ["earlier", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
