"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

The inverted index covers the benchmark items. Every passage of every document
is a query: passages are windows of words, twice as long as the longest item and
half overlapping, so each stretch as long as an item lies in one whole. Items are
indexed in classes of lengths (doubling), each with passages of its own length,
so one long item does not stretch the passages of the others.

Block-max WAND returns exactly the items at or above the threshold, which is a
share of the score an item gets as a query for itself. Postings hold what a term
adds as a share of the item's threshold, so all items are retrieved from a sum
of 1 and the bounds of terms and blocks are as tight as can be. The first pivot
test is made for all passages of a document together; most have no pivot, the
others go through their lists one by one.

A retrieved pair is a leak if the passage holds enough of the item's question and
of its answer (the last sentence; all of an item of one sentence), by shares of
their word 5-grams.

Layout for scale
  Documents are read once and not shuffled. The index is as large as its postings
  (16 bytes each, and the words) and goes to the executors whole: a benchmark of
  20,000 items of 60 words is 1.2 million postings. Only a benchmark of over
  PART_CHARS of text (about 100,000 items) is cut into parts by a hash of the id,
  each with a reading of the documents; term statistics are over all items.

Defined results
  Words are runs of letters and digits, lower-cased. Null and empty texts are
  no query; items without words cannot leak. Null ids take no part. Rows that
  repeat a document's id are searched each and reported together, those that
  repeat an item's id are items each and reported under it once. Of passages that
  hold an item equally well the first is told. Texts of any length are searched
  whole. Other columns are ignored by ``find_leaks``, whatever their names, and
  kept by ``without_leaks``. An empty table on either side gives no leaks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: BM25 constants.
K1, B = 1.2, 0.75
#: Share of its own score from which an item is retrieved; share of 5-grams from which it has leaked.
RETRIEVE, OVERLAP, N = 0.6, 0.8, 5
#: Postings in a block.
BLOCK = 32
#: Items of up to 2**SHORTEST words are one class.
SHORTEST = 4
#: Characters of item text in one part of the index.
PART_CHARS = 32_000_000
#: Passages whose pivots are looked for at a time.
TOGETHER = 1024
#: Sums from here on count as 1; no item comes after the last.
ENOUGH, END = 1 - 1e-9, 2**31
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last one."""
    parts = [w for p in _SENTENCE.split(text) if (w := words_of(p))]
    if len(parts) < 2:
        whole = parts[0] if parts else []
        return whole, whole
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[str], n: int = N) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], there: list[str]) -> float:
    """Share of the n-grams of ``part`` that ``there`` has."""
    want = grams(part)
    if not want:
        return 0.0
    return len(want & _sized(there, min(N, len(part)))) / len(want)


def _sized(words: list[str], n: int) -> set:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


@dataclass
class Index:
    """Inverted index of items of about one length.

    Postings are stored by term in item order, each with what the term adds to
    the item's score as a share of the item's threshold, so an item is retrieved
    from a sum of 1. Terms and blocks of BLOCK postings keep their largest share.
    """

    items: list[int]
    parts: list[tuple[list[str], list[str]]]
    #: Item's threshold: what a share is a share of.
    threshold: list[float]
    #: Words of the items of all classes.
    terms: dict[str, int]
    #: Term t has the postings from start[t] to start[t + 1].
    start: np.ndarray
    item: np.ndarray
    share: np.ndarray
    #: Largest share of a term; unknown words (the last entry) have none.
    most: np.ndarray
    #: Largest shares of the blocks of each term's postings, from block_start[t] on.
    block_start: np.ndarray
    block_most: np.ndarray
    #: Words of a passage.
    passage: int
    #: Lists that searches have met, as Python lists; no more than the postings.
    seen: dict[int, tuple] = field(default_factory=dict)

    def lists(self, terms: list[int]) -> list[list]:
        """Each term's current item, place, bound, items, shares and block bounds."""
        out = []
        for t in terms:
            x = self.seen.get(t)
            if x is None:
                at = slice(int(self.start[t]), int(self.start[t + 1]))
                x = self.item[at].tolist(), self.share[at].tolist(), self.block_most[self.block_start[t] : self.block_start[t + 1]].tolist(), float(self.most[t])
                self.seen[t] = x
            items, shares, blocks, most = x
            out.append([items[0], 0, most, items, shares, blocks])
        return out


def build(items: list[tuple[int, str]], n_items: int, mean_length: float, document_count: dict[str, int], terms: dict[str, int] | None = None) -> Index:
    """Index ``items``; the statistics are those of all items of the benchmark."""
    items = sorted(items)
    bags = [Counter(words_of(t)) for _, t in items]
    if terms is None:
        terms = {w: t for t, w in enumerate(dict.fromkeys(w for b in bags for w in b))}
    lists: list[list[tuple[int, float]]] = [[] for _ in terms]
    threshold = []
    for k, bag in enumerate(bags):
        norm = K1 * (1 - B + B * sum(bag.values()) / mean_length)
        adds = {w: np.log1p((n_items - document_count[w] + 0.5) / (document_count[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in bag.items()}
        threshold.append(RETRIEVE * float(sum(adds.values())))
        for w, add in adds.items():
            lists[terms[w]].append((k, float(add) / threshold[-1]))
    size = np.array([len(x) for x in lists], np.int64)
    blocks = -(-size // BLOCK)
    block_start = np.r_[0, np.cumsum(blocks)]
    share = np.array([s for x in lists for _, s in x])
    block = np.concatenate([block_start[t] + np.arange(len(x)) // BLOCK for t, x in enumerate(lists)])
    most, block_most = np.zeros(len(terms) + 1), np.zeros(block_start[-1])
    np.maximum.at(block_most, block, share)
    np.maximum.at(most, np.repeat(np.arange(len(terms)), size), share)
    return Index(
        items=[i for i, _ in items],
        parts=[question_and_answer(t) for _, t in items],
        threshold=threshold,
        terms=terms,
        start=np.r_[0, np.cumsum(size)],
        item=np.array([k for x in lists for k, _ in x], np.int64),
        share=share,
        most=most,
        block_start=block_start,
        block_most=block_most,
        passage=2 * max(sum(b.values()) for b in bags),
    )


NOW, AT, MOST, ITEMS, SHARES, BLOCKS = range(6)
_by_item = itemgetter(NOW)


def _go(x: list, item: int) -> None:
    """To the first posting at ``item`` or after."""
    items = x[ITEMS]
    x[AT] = at = bisect_left(items, item, x[AT])
    x[NOW] = items[at] if at < len(items) else END


def _block_at(x: list, item: int) -> tuple[float, int]:
    """Bound of the block that holds ``item``'s place in a list, and where the block ends."""
    items = x[ITEMS]
    at = bisect_left(items, item, x[AT])
    if at >= len(items):
        return 0.0, END
    last = (at // BLOCK + 1) * BLOCK - 1
    return x[BLOCKS][at // BLOCK], (items[last] if last < len(items) else END - 1)


def wand(ix: Index, terms: list[int]) -> list[tuple[int, float]]:
    """Items whose BM25 score for the distinct ``terms`` reaches their threshold.

    Block-max WAND over whole lists: lists stand in the order of their current
    items; the pivot is where the terms' bounds first sum to 1. If the bounds of
    the blocks at the pivot do not, everything up to the nearest block end is
    passed over; else the lists meet at the pivot, which is scored in full.
    """
    lists = ix.lists(terms)
    left = sum(x[MOST] for x in lists)
    lists.sort(key=_by_item)
    out = []
    while left >= ENOUGH - 1e-6:
        total, p = 0.0, -1
        while total < ENOUGH:
            p += 1
            if p == len(lists):
                return out
            total += lists[p][MOST]
        pivot = lists[p][NOW]
        while p + 1 < len(lists) and lists[p + 1][NOW] == pivot:
            p += 1
        bound, upto = 0.0, END
        for x in lists[: p + 1]:
            most, end = _block_at(x, pivot)
            bound += most
            upto = min(upto, end)
        if bound < ENOUGH:
            # no item up to the nearest block end, or to the next list, can do
            aim = min(upto + 1, lists[p + 1][NOW] if p + 1 < len(lists) else END)
        elif lists[0][NOW] == pivot:
            score = 0.0
            for x in lists[: p + 1]:
                score += x[SHARES][x[AT]]
            if score >= ENOUGH:
                out.append((pivot, score))
            aim = pivot + 1
        else:
            aim = pivot
        for x in lists[: p + 1]:
            if x[NOW] < aim:
                _go(x, aim)
                if x[NOW] == END:
                    left -= x[MOST]
        lists = [x for x in lists if x[NOW] < END]
        lists.sort(key=_by_item)
    return out


def _with_pivots(ix: Index, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(first word, distinct terms) of the passages in which a pivot can be.

    The pivot test for many passages at once: lists of one block are summed up at
    their items, longer ones count with their bounds. What is left out has no item
    that reaches its threshold.
    """
    n, size, unknown = len(ids), ix.passage, len(ix.terms)
    # bounds of all words, repeats counted, then of the distinct ones
    reach = np.zeros(n + 1)
    np.cumsum(ix.most[ids], out=reach[1:])
    starts = starts[reach[np.minimum(starts + size, n)] - reach[starts] >= ENOUGH]
    if not len(starts):
        return
    padded = np.full(n + size, unknown)
    padded[:n] = ids
    length = np.diff(ix.start)
    for lo in range(0, len(starts), TOGETHER):
        some = starts[lo : lo + TOGETHER]
        keys = np.unique(np.arange(len(some))[:, None] * (unknown + 1) + padded[some[:, None] + np.arange(size)])
        at, terms = np.divmod(keys, unknown + 1)
        known = ix.most[terms] > 0
        at, terms = at[known], terms[known]
        long = length[terms] > BLOCK
        bound = np.bincount(at[long], ix.most[terms[long]], len(some))
        a, t = at[~long], terms[~long]
        many = length[t]
        where = np.repeat(ix.start[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
        pairs, of = np.unique(np.repeat(a, many) * len(ix.items) + ix.item[where], return_inverse=True)
        best = np.zeros(len(some))
        np.maximum.at(best, pairs // len(ix.items), np.bincount(of, ix.share[where], len(pairs)))
        edge = np.searchsorted(at, np.arange(len(some) + 1))
        for k in np.flatnonzero(bound + best >= ENOUGH).tolist():
            yield int(some[k]), terms[edge[k] : edge[k + 1]].tolist()


def _search(ix: Index, words: list[str], ids: np.ndarray, best: dict[int, tuple]) -> None:
    """Leaks of ``ix``'s items among ``words``, the best passage of each into ``best``."""
    n, size = len(words), ix.passage
    step = size // 2
    for a, mine in _with_pivots(ix, ids, np.arange(0, max(1, n - step), step)):
        z = min(n, a + size)
        for k, share in wand(ix, mine):
            there = words[a:z]
            question, answer = ix.parts[k]
            q = overlap(question, there)
            r = overlap(answer, there) if q >= OVERLAP else 0.0
            score = share * ix.threshold[k]
            i = ix.items[k]
            if q >= OVERLAP and r >= OVERLAP and (i not in best or (q + r, score) > (best[i][2] + best[i][3], best[i][1])):
                best[i] = (i, score, q, r, a, z)


def leaks_in(indexes: list[Index], text: str | None) -> list[tuple[int, float, float, float, int, int]]:
    """(item, best score, question overlap, answer overlap, first word, end word) of a text."""
    words = words_of(text)
    best: dict[int, tuple] = {}
    if words and indexes:
        terms = indexes[0].terms
        ids = np.fromiter(map(terms.get, words, repeat(len(terms))), np.int64, len(words))
        for ix in indexes:
            _search(ix, words, ids, best)
    return [best[i] for i in sorted(best)]


def _built(items: list[tuple[int, str]], n_items: int, mean_length: float, document_count: dict[str, int]) -> list[Index]:
    """An index for each class of item lengths, so passages fit their items."""
    classes: dict[int, list[tuple[int, str]]] = {}
    for i, t in items:
        if n := len(words_of(t)):
            classes.setdefault(max(SHORTEST, (n - 1).bit_length()), []).append((i, t))
    terms = {w: t for t, w in enumerate(dict.fromkeys(w for some in classes.values() for _, text in some for w in words_of(text)))}
    return [build(some, n_items, mean_length, document_count, terms) for _, some in sorted(classes.items())]


def indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The benchmark's indexes; one list for each PART_CHARS of item text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = -(-size // PART_CHARS)
    if parts <= 1:
        got = [(r.item_id, r.text) for r in items.collect()]
        bags = [b for _, t in got if (b := words_of(t))]
        counts = Counter(w for b in bags for w in set(b))
        if bags:
            yield _built(got, len(bags), sum(map(len, bags)) / len(bags), counts)
        return

    def split(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts:
            rows = [(i, words_of(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.list_(pa.string()))], ["item_id", "words"])

    prepare(benchmark.sparkSession)
    items = stored(items, "items")
    bags = items.mapInArrow(split, "item_id long, words array<string>").filter(F.size("words") > 0)
    n, mean = bags.agg(F.count("*"), F.avg(F.size("words"))).first()
    counts = stored(bags.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "terms")
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    for k in range(parts):
        got = [(r.item_id, r.text) for r in items.filter(part == k).toLocalIterator()]
        there = bags.filter(part == k).select(F.explode("words").alias("w")).distinct()
        yield _built(got, n, mean, {r.w: r.n for r in counts.join(there, "w").toLocalIterator()})


_LEAKS = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, first_word long, end_word long"


def _searcher(ix: list[Index]):
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _LEAKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if doc is not None for x in leaks_in(ix, text)]
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) pairs that leak, with scores and the passage's words."""
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for ix in indexes(benchmark):
        found = source.mapInArrow(_searcher(ix), _LEAKS)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], _LEAKS)
    # rows that repeat an id are reported together: by the best passage, the first of equal ones
    rest = [c for c in out.columns if c not in ("doc_id", "item_id")]
    order = [-(F.col("question_overlap") + F.col("answer_overlap")), -F.col("question_overlap"), "first_word", "end_word"]
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct(*order, -F.col("bm25"), F.struct(*rest).alias("told"))).alias("m"))
    return best.select("doc_id", "item_id", *[F.col(f"m.told.{c}") for c in rest])


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, each judged by itself.

    Rows are dropped where they are read: nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def dropper(ix: list[Index]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not leaks_in(ix, t) for t in batch.column("text").to_pylist()], pa.bool_()))

        return run

    for ix in indexes(benchmark):
        docs = docs.mapInArrow(dropper(ix), docs.schema)
    return docs
