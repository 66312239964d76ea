"""MinHash-banded self join of documents on the Jaccard similarity of word n-grams.

Rows: bands of MinHash values, their number and width chosen for a target recall
at the threshold. Documents that share a band hash are compared by their sketches
(a byte of each MinHash value); pairs whose sketches do not rule a link out are
verified on the full n-gram sets, so a link is reported exactly when the similarity
reaches the threshold. Only verified links join classes.

Layout for scale
  * Documents with equal n-gram sets fall together first (one representative a
    class), so a group of copies costs one signature however large it is.
  * Bands are shuffled as (band hash, representative, sketch). Large buckets are
    compared block by block in many tasks. Pairs are told only where a document
    has few near ones in a bucket; a crowd of near copies is told by one edge a
    row, and compared in blocks of bounded size (see graph.py).
  * Only documents with a near partner move texts: once to a table of their own,
    and from there to their pairs, or to the blocks of their crowd.
  * Components are found by alternating star rounds in shared tables.

Defined results
  Words are runs of non-white-space (ASCII), unchanged. A text of fewer than n
  words has one n-gram, all its words; a text without words (null, empty) links
  with nothing and is its own class. An empty table gives no rows. A similarity
  of the threshold itself is a link. Texts of any length are taken whole. Rows
  with a null id are left out of ``jaccard_join`` and kept by ``keep_one``.
  Every distinct (id, text) takes part; a document is reported under the text with
  the smallest of its n-gram set hashes. Of a class ``keep_one`` keeps the rows of
  one (id, text), the smallest. Other columns are ignored by ``jaccard_join`` and
  kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from .common import WordHashes, free_names, hashed, prepare, rolling, stored, words_of
from .graph import candidates, exact_links

N, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Multipliers and offsets of the MinHash functions come from this seed.
SEED = 20240501


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the widest bands whose recall at ``threshold`` holds.

    A pair of similarity s shares a band with probability 1 - (1 - s**r)**b.
    Wider bands give fewer chance candidates; ``most`` bounds b * r.
    """
    best = None
    for r in range(1, 33):
        p = threshold**r
        b = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if b * r <= most:
            best = (b, r)
    if best is None:
        raise ValueError("no banding within the bound reaches that recall")
    return best


def grams(text: str | None, n: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashed(words, cache), min(n, len(words))))


def _signer(n: int, bands: int, rows: int):
    rng = np.random.default_rng(SEED)
    k = bands * rows
    a = (rng.integers(0, 2**32, (k, 1), np.uint64) | np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 2**32, (k, 1), np.uint64).astype(np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, keys, sigs, hashes, sketches = [], [], [], [], []
            for doc, text, code in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if doc is None:
                    continue
                g = grams(text, n, cache)
                ids.append(doc)
                hashes.append(code)
                if not len(g):
                    keys.append(None)
                    sigs.append(None)
                    sketches.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(g.tobytes()))
                low = np.full((k, 1), 0xFFFFFFFF, np.uint32)
                x = (g >> np.uint64(32)).astype(np.uint32)
                for s in range(0, len(x), 8192):
                    y = a * (x[None, s : s + 8192] ^ b)
                    low = np.minimum(low, (y ^ (y >> np.uint32(15))).min(axis=1, keepdims=True))
                m = low.reshape(bands, rows)
                sketches.append((low & np.uint32(255)).astype(np.uint8).tobytes())
                sigs.append([xxhash.xxh3_64_intdigest(m[t].tobytes(), t) - 2**63 for t in range(bands)])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(hashes, pa.int64()), pa.array(sketches, pa.binary())], ["doc_id", "gram_key", "bands", "text_hash", "sketch"])

    return sign


class _Jaccard:
    """Exact similarity of the n-gram sets of a table's rows."""

    def __init__(self, table: pa.Table, n: int, threshold: float):
        cache = WordHashes()
        sets = [grams(t, n, cache) for t in table.column("text").to_pylist()]
        self.size = np.array([len(s) for s in sets])
        self.threshold = threshold
        of = np.repeat(np.arange(len(sets)), self.size)
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, of = values[order], of[order]
        new = np.r_[True, values[1:] != values[:-1]]
        gram = np.cumsum(new) - 1
        shared = np.bincount(gram)[gram] > 1  # the others meet nothing
        self.row = of[shared]
        self.gram = np.unique(gram[shared], return_inverse=True)[1] if shared.any() else gram[:0]
        order = np.argsort(self.gram, kind="stable")
        self.row, self.gram = self.row[order], self.gram[order]

    def links(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = np.zeros((len(x), len(y)), np.float32)
        px, py = np.full(len(self.size), -1), np.full(len(self.size), -1)
        px[x], py[y] = np.arange(len(x)), np.arange(len(y))
        total = int(self.gram[-1]) + 1 if len(self.gram) else 0
        wide = 8192
        for s in range(0, total, wide):  # incidence matrices of a bounded width
            lo, hi = np.searchsorted(self.gram, [s, s + wide])
            r, c = self.row[lo:hi], self.gram[lo:hi] - s
            w = min(wide, total - s)
            a, b = np.zeros((len(x), w), np.float32), np.zeros((len(y), w), np.float32)
            k = px[r] >= 0
            a[px[r[k]], c[k]] = 1
            k = py[r] >= 0
            b[py[r[k]], c[k]] = 1
            both += a @ b.T
        union = self.size[x][:, None] + self.size[y][None, :] - both.astype(np.float64)
        return both / union >= self.threshold


def _paired(n: int, threshold: float):
    """Links of texts side by side; a text in many pairs is cut into n-grams once a batch."""

    def of(one: pa.Table, other: pa.Table) -> np.ndarray:
        cache, known = WordHashes(), {}
        out = np.zeros(one.num_rows, bool)
        for k, pair in enumerate(zip(one.column("text").to_pylist(), other.column("text").to_pylist(), strict=True)):
            for t in pair:
                if t not in known:
                    known[t] = grams(t, n, cache)
            a, b = known[pair[0]], known[pair[1]]
            if min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                out[k] = both / (len(a) + len(b) - both) >= threshold
        return out

    return of


def sketch_bound(threshold: float, values: int) -> int:
    """Equal bytes that a pair at ``threshold`` has at least, but for 1 in 100,000."""
    p = threshold + (1 - threshold) / 256
    return math.floor(values * p - 4.5 * math.sqrt(values * p * (1 - p)))


def _near(threshold: float, values: int):
    least = sketch_bound(threshold, values)

    def near(table: pa.Table):
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, values)

        def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            same = np.empty(len(a), np.int64)
            for s in range(0, len(a), 32768):
                same[s : s + 32768] = (sketch[a[s : s + 32768]] == sketch[b[s : s + 32768]]).sum(axis=1)
            return same >= least

        return of

    return near


def _classes(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Every (id, text) with its n-gram set, and every set's class.

    The second table has gram_key, copies, n_links, and keep_doc and keep_hash: the
    smallest (id, text) reachable by links.
    """
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = bands_for(threshold, recall)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    signed = stored(source.mapInArrow(_signer(n, bands, rows), "doc_id long, gram_key binary, bands array<long>, text_hash long, sketch binary"), "signed")
    member = signed.filter("gram_key is not null").groupBy("doc_id", "gram_key").agg(F.min("text_hash").alias("text_hash"))
    classes = member.groupBy("gram_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"), F.count("*").alias("copies")).select("gram_key", F.col("m.doc_id").alias("rep"), "m.text_hash", "copies")
    # a class is known by its smallest id; where that id has other texts too, all but one by a hash
    first = member.groupBy(F.col("doc_id").alias("rep")).agg(F.min("gram_key").alias("first"))
    classes = stored(classes.join(first, "rep").withColumn("node", F.when(F.col("gram_key") == F.col("first"), F.col("rep")).otherwise(F.xxhash64("gram_key", "rep"))).drop("first"), "classes")
    reps = signed.join(classes.select("gram_key", F.col("rep").alias("doc_id"), "text_hash", "node"), ["doc_id", "gram_key", "text_hash"]).dropDuplicates(["node"])
    reps = stored(reps.select("node", "bands", "sketch"), "reps")
    banded = reps.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    crowds, pairs = candidates(banded, reps.select("node", "sketch"), _near(threshold, bands * rows), "bands")
    wanted = crowds.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stored(wanted.join(classes, "node").select("node", F.col("copies").alias("weight"), F.col("rep").alias("doc_id"), "text_hash"), "wanted")
    # of rows that repeat id and text, one stands for them
    texts = stored(source.join(small(wanted), ["doc_id", "text_hash"]).select("node", "weight", "text").dropDuplicates(["node"]), "texts")
    links, joined = exact_links(crowds, pairs, texts, lambda t: _Jaccard(t, n, threshold), _paired(n, threshold), "verified")
    linked = classes.join(joined, "node").join(links, "node", "left")
    keep = linked.groupBy("root").agg(F.min(F.struct("rep", "text_hash")).alias("k"))
    found = linked.join(keep, "root").select("gram_key", F.col("k.rep").alias("keep_doc"), F.col("k.text_hash").alias("keep_hash"), "links")
    told = classes.join(found, "gram_key", "left").select(
        "gram_key",
        "copies",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("keep_doc", "rep").alias("keep_doc"),
        F.coalesce("keep_hash", "text_hash").alias("keep_hash"),
    )
    return signed.select("doc_id", "gram_key", "text_hash"), told


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    class_id is the smallest doc_id reachable by links (copies included), and
    n_links the number of other documents at ``threshold`` or above.
    """
    signed, told = _classes(docs, n, threshold, recall)
    one = signed.groupBy("doc_id").agg(F.min("gram_key").alias("gram_key"))
    return one.join(told, "gram_key", "left").select(
        "doc_id", F.coalesce("keep_doc", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies")
    )


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that another row of their class stands for."""
    settings = {"n": N, "threshold": THRESHOLD, "recall": RECALL} | settings
    signed, told = _classes(docs, **settings)
    row, code = free_names(docs, "row", "code")
    gone = signed.join(told, "gram_key").filter((F.col("doc_id") != F.col("keep_doc")) | (F.col("text_hash") != F.col("keep_hash"))).select(F.col("doc_id").alias(row), F.col("text_hash").alias(code))
    coded = docs.withColumn(row, F.col("doc_id").cast("long")).withColumn(code, F.xxhash64("text"))
    return coded.join(small(stored(gone, "gone")), [row, code], "left_anti").select(docs.columns)
