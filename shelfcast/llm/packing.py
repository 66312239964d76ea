"""Vector best-fit packing of tokenised documents into training sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). An item takes (length, 1, length**2) of them. Items are
placed longest first into the bin that best fits under every constraint: the
smallest weighted norm of what would be left, or the largest weighted dot
product of item and residual.

Items of one length are alike, so the plan is made on the exact histogram of
lengths, which has at most ``tokens`` entries whatever the size of the corpus,
with groups of bins of equal residual in place of bins. The plan lists runs of
ranks per length; each piece then finds its bin from its rank among the pieces
of its length. Ranks come from per-task counts and a running sum over them, so
no task ever holds the pieces of one length. The result equals best-fit
decreasing over single items.

Defined results
  Columns besides doc_id and text are ignored, so names can't clash. Pieces of one
  length are placed in the order of their ranks; ids, null ones too, play no part.
  A null or empty text is the end token alone. Only documents longer than the
  token capacity are cut, into full pieces and a last shorter one. Rows that
  repeat an id are packed once each. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored

@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, attention cost; None: unlimited."""

    tokens: int = 4096
    documents: int | None = None
    cost: int | None = None

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.tokens if self.documents is None else self.documents, self.tokens**2 if self.cost is None else self.cost], np.int64)


#: Characters of text tokenised at a time.
SLICE = 2_000_000
#: Distinct parts of texts whose ids a worker keeps (about 200 MB).
PARTS = 800_000
_SPACE = " \\t\\n\\r\\x0b\\x0c"
_LOWER = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[{_LOWER}]+|[^{_SPACE}{_LOWER}]+")
#: A chunk with an apostrophe or a letter-like sign is one part.
_JOINED = "'\u00aa\u00b5\u00ba"
_WHOLE = re.compile(f"[^{_SPACE}{_JOINED}]*+[{_JOINED}][^{_SPACE}]*+|[{_LOWER}]+|[^{_SPACE}{_LOWER}{_JOINED}]+")


class PartIds(dict):
    """Part of a text -> its token ids as little-endian uint32.

    The tokenizer lower-cases, drops white space and ends a word where letters
    end, so a text's ids are those of its parts in order. Latin-1 texts split
    into runs of letters and runs of other signs; where an apostrophe may start
    a contraction, and in all other texts, the parts are white-space-free
    chunks. Only parts not met before go through the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def parts(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return [x.decode() for x in text.encode("utf-8", "replace").split()]
        if "<|" in text:
            return [x.decode("latin-1") for x in text.encode("latin-1").split()]
        low = text.lower()
        return (_WHOLE if any(c in low for c in _JOINED) else _PLAIN).findall(low)

    def learn(self, many: list[list[str]]) -> None:
        new = [x for x in set().union(*many) if x not in self]
        if len(self) + len(new) > PARTS:
            self.clear()
            new = list(set().union(*many))
        words = [x for x in new if x.isalpha() and x.isascii()]
        groups = [words[i : i + 50] for i in range(0, len(words), 50)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):  # a vocabulary that marks ends otherwise
                for word in group:
                    self[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            for word, part in zip(group, np.split(ids, cuts[:-1]), strict=True):
                self[word] = part.tobytes()
        rest = [x for x in new if not (x.isalpha() and x.isascii())]
        for part, got in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[part] = np.array(got.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            held, many = 0, []
            while at < len(texts) and held < SLICE:
                text = texts[at] or ""
                many.append(self.parts(text))
                held += len(text) + 1
                at += 1
            self.learn(many)
            for parts in many:
                yield b"".join(map(self.__getitem__, parts))


_SHARED: dict[str, PartIds] = {}


def shared_ids(path: str) -> PartIds:
    """The worker's cache of parts; a Python worker runs many tasks."""
    if path not in _SHARED:
        _SHARED[path] = PartIds(path)
    return _SHARED[path]


def _tokenised(path: str, tokens: int, end: int, keep_ids: bool):
    stop = np.array([end], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "slot"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared_ids(path)
        pid, slots = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        step = 4 * tokens
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in names}
            for doc, ids in zip(batch.column(0).to_pylist(), cache.encode(batch.column(1).to_pylist()), strict=True):
                ids += stop
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    length = len(part) // 4
                    for n, v in zip(names, (doc, piece, at // 4, length, zlib.crc32(part), pid, int(slots[length]), part), strict=False):
                        rows[n].append(v)
                    slots[length] += 1
            yield pa.record_batch([pa.array(rows[n], kind) for n, kind in zip(names, _KINDS, strict=False)], names)

    return run


_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, slot long"


def plan(histogram: dict[int, int], capacity: Capacity, weights=(1.0, 1.0, 1.0), rule: str = "norm") -> np.ndarray:
    """Best-fit decreasing over counts of lengths.

    Returns runs, one a row: length, first rank, items, items a bin, first bin,
    first offset. Item r of a run goes to bin ``first + r // a_bin``.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    cap = capacity.vector()
    w = np.asarray(weights, float)
    res = np.empty((64, 3), np.int64)  # residuals of the groups of bins
    first = np.empty(64, np.int64)
    size = np.zeros(64, np.int64)
    n, bins, runs = 0, 0, []

    def grown() -> None:
        nonlocal res, first, size
        if n >= len(size):
            res, first, size = (np.concatenate([x, np.empty_like(x)]) for x in (res, first, size))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        item = np.array([length, 1, length**2], np.int64)
        if (item > cap).any():
            raise ValueError(f"an item of {length} tokens exceeds the capacity of a sequence")
        # groups that no remaining item fits any more are closed
        if n and (n & 255) == 0:
            open_ = size[:n] > 0
            m = int(open_.sum())
            res[:m], first[:m], size[:m], n = res[:n][open_], first[:n][open_], size[:n][open_], m
        while left:
            fits = np.flatnonzero((size[:n] > 0) & (res[:n] >= item).all(axis=1))
            if len(fits):
                r = res[fits] / cap
                i = item / cap
                score = np.sqrt((w * (r - i) ** 2).sum(axis=1)) if rule == "norm" else -(w * r * i).sum(axis=1)
                g = fits[np.argmin(score)]
                many = int((res[g] // item).min()) if rule == "norm" else 1
            else:
                many = int((cap // item).min())
                grown()
                g, n = n, n + 1
                res[g], first[g], size[g] = cap, bins, -(-left // many)
                bins += int(size[g])
            for a_bin in (many, left % many):
                used = min(int(size[g]), left // a_bin if a_bin else 0)
                if a_bin == 0 or used == 0:
                    continue
                if a_bin != many:
                    used = 1
                runs.append((length, rank, used * a_bin, a_bin, int(first[g]), int(cap[0] - res[g, 0])))
                grown()
                res[n], first[n], size[n] = res[g] - a_bin * item, first[g], used
                n += 1
                first[g] += used
                size[g] -= used
                rank += used * a_bin
                left -= used * a_bin
    return np.array(runs, np.int64).reshape(-1, 6)


def _placed(runs: np.ndarray, top: int, names: list[str]):
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order]
    shift = np.int64(1) << np.int64(44)
    keys = runs[:, 0] * shift + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * shift + rank, "right") - 1
            _, r0, _, many, bin0, off0 = runs[at].T
            j = rank - r0
            cols = [batch.column(n) for n in names] + [pa.array(bin0 + j // many), pa.array(off0 + j % many * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end: int = 1, weights=(1.0, 1.0, 1.0), rule: str = "norm", keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence and place in it.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``keep_ids`` the ids as little-endian unsigned 32-bit numbers.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema = _PIECES + ", ids binary" * keep_ids
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = stored(source.mapInArrow(_tokenised(tokenizer, capacity.tokens, end, keep_ids), schema), "pieces")
    counts = pieces.groupBy("length", "pid").agg((F.max("slot") + 1).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = pieces.join(offsets, ["length", "pid"]).select(*names, (F.col("before") + F.col("slot")).alias("rank"))
    out = ", ".join(x for x in schema.split(", ") if x.split()[0] in names) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placed(plan(histogram, capacity, weights, rule), capacity.tokens, names), out)
