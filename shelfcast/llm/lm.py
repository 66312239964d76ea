"""Cross-entropy difference of matched bigram models.

A target and a background model share vocabulary, order and smoothing; both
count every document they cover. A document's score is its loss a token under
the target model less that under the background model: low means target-like.
Each document is left out of the counts it is scored with.

  p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU),  p(w) = (c(w) + 1) / (n + |V|)

Layout for scale
  * The vocabulary is all words, each known by a 62-bit hash. The counts of the
    HELD most frequent ones are sent to all executors, which changes no result:
    a held word is only written shorter, as a number.
  * Bigrams of held words go to reducers by a hash of the pair, five bytes each,
    in one row a (mapper, task). A task counts its bigrams and returns partial
    sums a document, in one row a document task: what mappers know already goes
    through the same task and is added in, so the rows of the second shuffle
    depend neither on the mappers nor on repeats.
  * log p is the log of its numerator, which needs c(v, w) and p(w), less that of
    its denominator, which needs c(v). A bigram that ends in a word that isn't
    held goes to that word's task, where the numerator is known, as all of the
    word's occurrences meet there; one that begins with such a word goes to
    that word's task for the denominator. What concerns a held word is known
    in both. So no table of all words is joined, sent or collected.
  * Pairs of words that each make up 1/HOT of the corpus are few (HOT**2 at
    most) and may be a large share of all; their counts are summed in the
    mappers and sent to all executors, so no task holds a hot pair.

Defined results
  Words are runs of non-white-space, lower-cased; a text is framed by an end
  sign on both sides, so null and empty texts have one token, the end. Rows that
  repeat an id are scored as one document, however long. Rows with a null id are
  left out; columns besides doc_id and text are ignored, so names can't clash. A
  null target flag is false. An empty table gives no rows. An empty target leaves the smoothed prior. |V| counts
  the distinct words and the end sign; every word is one of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, dealt, mixed, prepare, reducers, runs_of, stored
from .substring import pack, unpack

#: Words whose counts all executors hold; the others' are counted in their tasks.
HELD = 65_000
HOT, MU = 256, 20.0
#: Codes of words that have no number are hashes from here on.
HASHED = 1 << 62
#: Bigrams a mapper gathers before it sends them.
FLUSH = 1_500_000


def _code(word: str) -> int:
    return HASHED | xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) >> 2


END = _code("\n")


class _Ids(dict):
    """word -> its number, else its code; misses are kept, up to a bound."""

    def __init__(self, held: dict[int, int]):
        super().__init__()
        self.held = held

    def __missing__(self, word: str) -> int:
        code = _code(word)
        value = self.held.get(code, code)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


def _words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def rows() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        out = pa.record_batch([pa.array(map(_code, words), pa.int64()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] + counts[1][w] for w in words], pa.int64())], ["word", "target", "every"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, flag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            counts[bool(flag)].update(_words(text))
            counts[bool(flag)]["\n"] += 1  # the end sign
        if len(counts[0]) + len(counts[1]) > CACHE_WORDS:
            yield rows()
    yield rows()


class Unigrams:
    """Counts by word number: 0 is no word, 1 the end sign.

    ``rows`` are the words with a number; ``distinct`` is the number of all words.
    """

    def __init__(self, rows: list, ends: tuple[int, int], totals: tuple[int, int], distinct: int):
        self.ids = _Ids({r.word: k for k, r in enumerate(rows, 2)} | {END: 1})
        # the end sign has its own number; its row stands for nothing
        known = np.array([[0, 0], list(ends), *[[0, 0] if r.word == END else [r.target, r.every] for r in rows]], np.float64)
        self.counts = known
        #: What is added up under a prior.
        self.mass = np.array(totals, np.float64) + max(distinct, 1)
        #: Bytes of the number of a pair of numbered words.
        self.width = max(5, (len(known) ** 2 - 1).bit_length() + 7 >> 3)
        self.prior = (known + 1) / self.mass
        share = known[:, 1] / max(totals[1], 1)
        self.hot = np.flatnonzero(share >= 1 / HOT)
        self.place = np.full(len(known), -1)
        self.place[self.hot] = np.arange(len(self.hot))

    def places(self, x: np.ndarray) -> np.ndarray:
        """Place of each code among the hot words, -1 for others."""
        there = x < len(self.counts)
        return np.where(there, self.place[np.where(there, x, 0)], -1)

    def encode(self, text: str | None) -> np.ndarray:
        words = _words(text)
        out = np.ones(len(words) + 2, np.int64)
        out[1:-1] = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        return out

    def losses(self, v: np.ndarray, w: np.ndarray, pairs: np.ndarray, own: np.ndarray, flag: np.ndarray) -> np.ndarray:
        """[bigram, model] loss of bigrams with counts ``pairs``, ``own`` of them from the document."""
        less = np.stack([own * flag, own], axis=1)
        top = np.maximum(pairs - less, 0) + MU * self.prior[w]
        return -np.log(top / (np.maximum(self.counts[v] - less, 0) + MU))

    def parts(self, ends_in: bool, a: np.ndarray, b: np.ndarray, d: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, [row, model] loss, tokens) of all bigrams of words ``a`` without a number.

        They end in ``a`` or begin with it; ``b`` is the other word. Of two words
        without a number, the numerator is told where the bigram ends in ``a``, the
        denominator where it begins.
        """
        order = np.lexsort((d, b, a))
        a, b, d, f = a[order], b[order], d[order], f[order]
        word = np.r_[True, a[1:] != a[:-1]]
        pair = word | np.r_[True, b[1:] != b[:-1]]
        edge = np.flatnonzero(pair | np.r_[True, d[1:] != d[:-1]])
        own = np.diff(np.r_[edge, len(d)]).astype(float)
        less = np.stack([np.add.reduceat(f.astype(float), edge), own], axis=1)
        word, pair, b, d = word[edge], pair[edge], b[edge], d[edge]

        def summed(first: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(first)
            return np.repeat(np.add.reduceat(less, at, axis=0), np.diff(np.r_[at, len(first)]), axis=0)

        known = b < len(self.counts)
        at, words, pairs = np.where(known, b, 0), summed(word), np.maximum(summed(pair) - less, 0)
        if ends_in:
            loss = -np.log(pairs + MU * (words + 1) / self.mass)
            loss += np.where(known[:, None], np.log(np.maximum(self.counts[at] - less, 0) + MU), 0)
            return d, loss * own[:, None], own
        loss = np.log(np.maximum(words - less, 0) + MU)
        loss -= np.where(known[:, None], np.log(pairs + MU * self.prior[at]), 0)
        return d, loss * own[:, None], np.where(known, own, 0)


def _hot_pairs(u: Unigrams):
    n = len(u.hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n * n), np.int64)
        for batch in batches:
            for text, flag in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                p = u.places(u.encode(text))
                k = (p[:-1] >= 0) & (p[1:] >= 0)
                c = np.bincount(p[:-1][k] * n + p[1:][k], minlength=n * n) if k.sum() > n * n // 8 else None
                if c is not None:
                    sums[1] += c
                    sums[0] += c * bool(flag)
                else:
                    at = p[:-1][k] * n + p[1:][k]
                    np.add.at(sums[1], at, 1)
                    if flag:
                        np.add.at(sums[0], at, 1)
        at = np.flatnonzero(sums[1])
        yield pa.record_batch([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["pair", "target", "every"])

    return run


def _partial(docs: np.ndarray, losses: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(docs, return_inverse=True)
    return ids, np.stack([np.bincount(at, losses[:, 0], len(ids)), np.bincount(at, losses[:, 1], len(ids)), np.bincount(at, tokens, len(ids))], axis=1)


def _pack_sums(ids: np.ndarray, sums: np.ndarray, tasks: int) -> tuple[list[int], list[bytes]]:
    at = dealt(ids, tasks)
    order = np.lexsort((ids, at))
    ids, sums, at = ids[order], sums[order], at[order]
    found = runs_of(at)
    return [k for k, _, _ in found], [
        len(ids[lo:hi]).to_bytes(4, "little") + np.diff(ids[lo:hi], prepend=np.int64(0)).astype("<i8").tobytes() + sums[lo:hi, :2].astype("<f8").tobytes() + sums[lo:hi, 2].astype("<u4").tobytes()
        for _, lo, hi in found
    ]


def _unpack_sums(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    ids = np.cumsum(np.frombuffer(data, "<i8", n, 4))
    return ids, np.c_[np.frombuffer(data, "<f8", 2 * n, 4 + 8 * n).reshape(n, 2), np.frombuffer(data, "<u4", n, 4 + 24 * n)]


def _squeeze(x: np.ndarray) -> bytes:
    """Codes, byte by byte of all, as those of numbers are mostly zeros."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()


#: Routes of a bigram: its words have numbers; it ends in a word without; it begins with one.
NUMBERED, ENDS, BEGINS = 0, 1, 2
_SENT = "k int, flag boolean, route int, bigrams binary, others binary, sums binary"


def _sender(u: Unigrams, hot: np.ndarray, tasks: int):
    size, n = np.int64(len(u.counts)), len(u.hot)

    def flush(held: list[tuple[int, bool, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ks: list[int] = []
        fs, rs, bs, os, ss = [], [], [], [], []
        docs = np.repeat(np.array([d for d, _, _ in held]), [len(x) - 1 for _, _, x in held])
        flags = np.repeat(np.array([f for _, f, _ in held]), [len(x) - 1 for _, _, x in held])
        v, w = np.concatenate([x[:-1] for _, _, x in held]), np.concatenate([x[1:] for _, _, x in held])
        pv, pw = u.places(v), u.places(w)
        is_hot = (pv >= 0) & (pw >= 0)
        # hot pairs: counts are known here
        d, pair, f = docs[is_hot], pv[is_hot] * n + pw[is_hot], flags[is_hot]
        order = np.lexsort((pair, d))
        d, pair, f = d[order], pair[order], f[order]
        edge = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (pair[1:] != pair[:-1])][: len(d)])
        own = np.diff(np.r_[edge, len(d)]).astype(float)
        pair, d, f = pair[edge], d[edge], f[edge]
        loss = u.losses(u.hot[pair // n], u.hot[pair % n], hot[pair], own, f) * own[:, None] if len(pair) else np.empty((0, 2))
        zero = np.array([x for x, _, _ in held])  # every document has a row
        ids, sums = _partial(np.r_[d, zero], np.r_[loss, np.zeros((len(zero), 2))], np.r_[own, np.zeros(len(zero))])
        at, data = _pack_sums(ids, sums, tasks)
        ks += at
        for x in (fs, rs, bs, os):
            x += [None] * len(at)
        ss += data
        far_v, far_w = v >= size, w >= size
        for route, there in ((NUMBERED, ~is_hot & ~far_v & ~far_w), (ENDS, far_w), (BEGINS, far_v)):
            for flag in (False, True):
                k = np.flatnonzero(there & (flags == flag))
                key = v[k] * size + w[k] if route == NUMBERED else w[k] if route == ENDS else v[k]
                b = dealt(mixed(key.astype(np.uint64)), tasks)
                order = np.lexsort((docs[k], b))
                k, key, b = k[order], key[order], b[order]
                d, other = docs[k], v[k] if route == ENDS else w[k]
                for at, lo, hi in runs_of(b):
                    ks.append(at)
                    fs.append(flag)
                    rs.append(route)
                    bs.append(pack(d[lo:hi], key[lo:hi], u.width if route == NUMBERED else 8))
                    os.append(None if route == NUMBERED else _squeeze(other[lo:hi]))
                    ss.append(None)
        yield pa.record_batch(
            [pa.array(ks, pa.int32()), pa.array(fs, pa.bool_()), pa.array(rs, pa.int32()), pa.array(bs, pa.binary()), pa.array(os, pa.binary()), pa.array(ss, pa.binary())],
            ["k", "flag", "route", "bigrams", "others", "sums"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc, text, flag in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = u.encode(text)
                held.append((doc, bool(flag), x))
                size += len(x)
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return send


def _judge(u: Unigrams, tasks: int):
    size = np.int64(len(u.counts))

    def numbered(d: np.ndarray, k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((d, k))
        d, k, f = d[order], k[order], f[order]
        # one entry per (bigram, document)
        edge = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        own = np.diff(np.r_[edge, len(d)]).astype(float)
        # rows that repeat an id with both flags: each counts where it belongs
        mine = np.add.reduceat(f.astype(float), edge)
        d, k = d[edge], k[edge]
        new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        many = np.diff(np.r_[new, len(k)])
        pairs = np.stack([np.repeat(np.add.reduceat(x, new), many) for x in (mine, own)], axis=1)
        return d, u.losses(k // size, k % size, pairs, own, mine / own) * own[:, None], own

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {route: ([], [], [], []) for route in (NUMBERED, ENDS, BEGINS)}
        made: list[tuple] = []
        for batch in batches:
            for data, other, route, flag, sums in zip(*(batch.column(c).to_pylist() for c in ("bigrams", "others", "route", "flag", "sums")), strict=True):
                if sums:  # worked out by the mapper: passed on with what is found here
                    ids, x = _unpack_sums(sums)
                    made.append((ids, x[:, :2], x[:, 2]))
                    if len(made) >= 256:
                        made = [_merged(made)]
                    continue
                d, k = unpack(data, u.width if route == NUMBERED else 8)
                docs, keys, others, flags = held[route]
                docs.append(d)
                keys.append(k.astype(np.int64))
                if route != NUMBERED:
                    others.append(_unsqueeze(other))
                flags.append(np.full(len(d), flag))
        for route in held:
            docs, keys, others, flags = held[route]
            held[route] = ([], [], [], [])
            if docs and route == NUMBERED:
                made.append(numbered(np.concatenate(docs), np.concatenate(keys), np.concatenate(flags)))
            elif docs:
                made.append(u.parts(route == ENDS, np.concatenate(keys), np.concatenate(others), np.concatenate(docs), np.concatenate(flags)))
        if made:
            d, loss, own = _merged(made)
            at, data = _pack_sums(d, np.c_[loss, own], tasks)
            yield pa.record_batch([pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["k", "sums"])

    return judge


def _merged(made: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, losses, tokens) of parts that name a document many times."""
    ids, sums = _partial(*(np.concatenate(x) for x in zip(*made, strict=True)))
    return ids, sums[:, :2], sums[:, 2]


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a document task: the sums of its documents, as they come in."""
    made: list[tuple] = []
    size = 0
    for batch in batches:
        for x in batch.column("sums").to_pylist():
            ids, sums = _unpack_sums(x)
            made.append((ids, sums[:, :2], sums[:, 2]))
            size += len(ids)
            if size > 4 * len(made[0][0]) + 100_000:
                made = [_merged(made)]
                size = 0
    if not made:
        return
    ids, loss, own = _merged(made)
    n = np.maximum(own, 1)
    t, b = loss[:, 0] / n, loss[:, 1] / n
    for lo in range(0, len(ids), 10_000):
        hi = lo + 10_000
        cols = [ids[lo:hi], own[lo:hi].astype(np.int64), t[lo:hi], b[lo:hi], (t - b)[lo:hi]]
        yield pa.record_batch([pa.array(c) for c in cols], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def held_above(words: DataFrame, most: int) -> int:
    """The lowest count such that at most ``most`` words have a higher one.

    Counts are grouped in 1,024 ranges, then those in the range where the words
    become too many, until it is a single count: no task or driver sees more than that.
    """
    lo, hi = 0, 1 + words.agg(F.coalesce(F.max("every"), F.lit(0))).first()[0]
    above = 0  # words with a count of hi or more
    while hi - lo > 1:
        step = -(-(hi - lo) // 1024)
        part = words.filter((F.col("every") >= lo) & (F.col("every") < hi)).groupBy(F.floor((F.col("every") - lo) / step).alias("r")).agg(F.count("*").alias("n"))
        for r in sorted(part.collect(), key=lambda r: -r.r):
            if above + r.n > most:
                lo, hi = lo + r.r * step, min(hi, lo + (r.r + 1) * step)
                break
            above += r.n
        else:
            return 0
    return lo


def cross_entropy_difference(docs: DataFrame, target: Column) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every document.

    ``target`` tells which rows of ``docs`` the target model covers; the
    background model covers all rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    tasks = reducers(spark)
    source = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(target, F.lit(False)).alias("flag"))
    words = stored(source.mapInArrow(_unigrams, "word long, target long, every long").groupBy("word").agg(F.sum("target").alias("target"), F.sum("every").alias("every")), "unigrams")
    *totals, distinct = words.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("every"), F.lit(0)), F.count("*")).first()
    least = held_above(words, HELD)
    known = words.filter((F.col("every") > least) | (F.col("word") == END)).collect()
    ends = next(((r.target, r.every) for r in known if r.word == END), (0, 0))
    u = Unigrams(sorted((r for r in known if r.every > least), key=lambda r: (-r.every, r.word)), ends, tuple(totals), distinct)
    hot = np.zeros((len(u.hot) ** 2, 2))
    for r in source.mapInArrow(_hot_pairs(u), "pair long, target long, every long").groupBy("pair").agg(F.sum("target").alias("target"), F.sum("every").alias("every")).collect():
        hot[r.pair] = r.target, r.every
    sent = source.mapInArrow(_sender(u, hot, tasks), _SENT)
    sums = sent.repartitionById(tasks, "k").mapInArrow(_judge(u, tasks), "k int, sums binary")
    return sums.repartitionById(tasks, "k").mapInArrow(_total, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
