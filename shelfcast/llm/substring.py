"""Exact substring de-duplication over fixed-length word windows.

Every window of ``width`` words gets a Rabin-Karp hash. Spark shuffles the
hashes by their leading bits, so one task sees all occurrences of its hashes and
names, for every document, the windows that also start in a document with a
smaller id. Overlapping windows merge into maximal intervals, which are removed
from the text.

Layout for scale
  * There are as many hash tasks and document tasks as the session has shuffle
    partitions, R. A mapper sends nine bytes a window, in one row a hash task.
  * Within what a mapper gathers a hash is sent once, for its smallest document;
    the other documents are known to repeat, and that goes straight on to their
    own tasks. A passage that a third of the corpus shares so costs one entry a
    mapper, and a group of copies one a mapper and window.
  * A hash task answers with one row a document task it has found anything for,
    whatever the number of mappers and of copies: no more rows than the blocks
    of the shuffle that carries them, and no more than (task, document) pairs.
  * Texts travel compressed, once, to meet their answers, sorted behind them: a
    task holds the answers for its documents (16 bytes a repeated window) and a
    batch of texts. A hash task holds its windows, about 40 bytes each, so R is to
    be set as for any shuffle of the input.

Hashes
  A window is known by two polynomial hashes: the task, 56 bits of the first one
  and 16 of the second, 72 + log2(R) bits. Both start from one 64-bit hash of each word,
  so different words with the same one (n * n / 2**65 pairs expected among n different
  words, 0.03 for a billion) are not told apart by either. Among n windows
  n * n / 2**(73 + log2 R) chance pairs are expected: 0.5 at 100 TB (2e13 windows,
  R = 100,000). The answer to a document names its own windows by 64 of these bits.

Defined results
  Null and empty texts have no words and stay as they are; an empty table gives
  no rows. A null id neither flags nor is flagged. Rows that repeat an id are
  judged alike: a window counts against them only if a smaller id has it. Ties
  can't arise, as a document never flags itself. Texts of any length are one
  document's. Input columns named like the columns added here are replaced by
  :func:`dedup_substrings` and kept by :func:`cut_texts`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE_2, WordHashes, arrow_schema, dealt, free_names, hashed, prepare, reducers, rolling, runs_of, words_of

WIDTH = 13
#: Windows gathered before a mapper sorts and sends them (64 MB of work space).
FLUSH = 1_500_000
#: Answers that a hash task gathers before it passes them on.
ANSWERS = 4_000_000
ADDED = ["n_words", "n_removed", "removed", "kept_sha256", "kept_text"]
_ADDED = "n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept_sha256 string, kept_text string"
_SENT = "task int, flags binary, hashes binary"
_LOW = np.uint64((1 << 56) - 1)


def pack(docs: np.ndarray, values: np.ndarray, width: int) -> bytes:
    """Runs of equal ``docs`` with the low ``width`` bytes of their values."""
    edge = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    counts = np.diff(np.r_[edge, len(docs)]).astype("<u4")
    head = zstandard.ZstdCompressor(level=1).compress(np.diff(docs[edge], prepend=np.int64(0)).astype("<i8").tobytes() + counts.tobytes())
    low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return len(edge).to_bytes(4, "little") + len(head).to_bytes(4, "little") + head + low


def unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    head = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    ids = np.cumsum(np.frombuffer(head, "<i8", n))
    counts = np.frombuffer(head, "<u4", n, 8 * n)
    low = np.frombuffer(data, np.uint8, offset=8 + size).reshape(-1, width)
    full = np.zeros((len(low), 8), np.uint8)
    full[:, :width] = low
    return np.repeat(ids, counts), full.view("<u8").ravel()


def windows(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, name, check) of every window of hashed words.

    The place deals windows to tasks. The name is 56 bits of the first hash and
    eight of the second, the check eight more of the second.
    """
    first, second = rolling(words, width), rolling(words, width, BASE_2)
    return first >> np.uint64(32), (first & _LOW) | (second & np.uint64(255)) << np.uint64(56), (second >> np.uint64(8)).astype(np.uint8)


def same_windows(name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal windows together, and where each kind starts in it."""
    order = np.argsort(name)
    equal = name[order][1:] == name[order][:-1]
    if (check[order][1:] != check[order][:-1])[equal].any():  # names that agree by chance
        order = np.lexsort((check, name))
        equal = (name[order][1:] == name[order][:-1]) & (check[order][1:] == check[order][:-1])
    return order, np.flatnonzero(np.r_[True, ~equal])


def _rows(task: list[int], flags: list[bytes | None], hashes: list[bytes | None]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(task, pa.int32()), pa.array(flags, pa.binary()), pa.array(hashes, pa.binary())], ["task", "flags", "hashes"])


def _answers(docs: np.ndarray, names: np.ndarray, tasks: int) -> tuple[list[int], list[bytes]]:
    """Packed (document, window) pairs, one entry a document task."""
    at = dealt(docs, tasks)
    order = np.lexsort((docs, at))
    docs, names, at = docs[order], names[order], at[order]
    found = runs_of(at)
    return [k for k, _, _ in found], [pack(docs[lo:hi], names[lo:hi], 8) for _, lo, hi in found]


def _sender(width: int, tasks: int):
    def flush(ids: list[int], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs = np.repeat(np.array(ids, np.int64), [len(p[0]) for p in parts])
        place, name, check = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, start = same_windows(name, check)
        docs, place, name, check = docs[order], place[order], name[order], check[order]
        least = np.minimum.reduceat(docs, start)
        again = docs != np.repeat(least, np.diff(np.r_[start, len(docs)]))
        task, flags = _answers(docs[again], name[again], tasks)
        hashes: list[bytes | None] = [None] * len(task)
        # one entry for each different window
        at = (place[start] * np.uint64(tasks) >> np.uint64(32)).astype(np.int32)
        order = np.lexsort((least, at))
        docs, name, check, at = least[order], name[start][order], check[start][order], at[order]
        for k, lo, hi in runs_of(at):
            task.append(k)
            flags.append(None)
            hashes.append((hi - lo).to_bytes(4, "little") + check[lo:hi].tobytes() + pack(docs[lo:hi], name[lo:hi], 8))
        yield _rows(task, flags, hashes)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ids, parts, held = WordHashes(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                found = windows(hashed(words_of(text), cache), width)
                if len(found[0]):
                    ids.append(doc)
                    parts.append(found)
                    held += len(found[0])
                if held >= FLUSH:
                    yield from flush(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield from flush(ids, parts)

    return send


def _unchecked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, names and checks of an entry: their number, the checks, the rest."""
    n = int.from_bytes(data[:4], "little")
    docs, names = unpack(data[4 + n :], 8)
    return docs, names, np.frombuffer(data, np.uint8, n, 4)


def _judge(tasks: int):
    """Of a hash task: the windows of a document that a smaller document has too."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, told, size = [], [], 0

        def passed_on() -> pa.RecordBatch:
            docs, names = (np.concatenate(x) for x in zip(*told, strict=True))
            task, flags = _answers(docs, names, tasks)
            return _rows(task, flags, [None] * len(task))

        for batch in batches:
            for flags, hashes in zip(batch.column("flags").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if hashes:
                    got.append(_unchecked(hashes))
                if flags:
                    told.append(unpack(flags, 8))
                    size += len(told[-1][0])
                    if size >= ANSWERS:
                        yield passed_on()
                        told.clear()
                        size = 0
        if got:
            docs, name, check = (np.concatenate(x) for x in zip(*got, strict=True))
            got.clear()
            order, start = same_windows(name, check)
            docs, name = docs[order], name[order]
            hit = docs != np.repeat(np.minimum.reduceat(docs, start), np.diff(np.r_[start, len(docs)]))
            told.append((docs[hit], name[hit]))
        if told and sum(len(d) for d, _ in told):
            yield passed_on()

    return judge


def _bodies(tasks: int, names: dict[str, str], schema: pa.Schema):
    """Rows of documents, their texts compressed, with their task."""

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column("text").to_pylist()
            # rows without an id are dealt by their text
            ids = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) >> 1 if x is None else x for x, t in zip(batch.column(names["id"]).to_pylist(), texts, strict=True)], np.int64)
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            cols[names["body"]] = pa.array([None if x is None else squeeze(x.encode("utf-8", "surrogatepass")) for x in texts], pa.binary())
            cols[names["task"]] = pa.array(dealt(ids, tasks), pa.int32())
            cols[names["row"]] = pa.array(np.ones(len(ids), np.int8))
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema=schema)

    return bodies


def covered(hits: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Words that lie in a window whose start is in ``hits``."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + width, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(width: int, names: dict[str, str], added: dict[str, str], out: pa.Schema):
    """Answers come first, then texts: take the named windows out of each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, unzip = WordHashes(), zstandard.ZstdDecompressor().decompress
        got: list[tuple] = []
        docs = flags = None
        for batch in batches:
            got += [unpack(x, 8) for x in batch.column(names["flags"]).to_pylist() if x]
            rows = batch.filter(batch.column(names["row"]).is_valid())
            if not rows.num_rows:
                continue
            if docs is None:
                docs, flags = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64), np.empty(0, np.uint64))
                order = np.argsort(docs, kind="stable")
                docs, flags = docs[order], flags[order]
                got = []
            made: dict[str, list] = {n: [] for n in ADDED}
            for doc, body in zip(rows.column(names["id"]).to_pylist(), rows.column(names["body"]).to_pylist(), strict=True):
                text = None if body is None else unzip(body)
                words = text.split() if text else []
                spans: list[dict] = []
                lo, hi = (0, 0) if doc is None else (np.searchsorted(docs, doc), np.searchsorted(docs, doc, "right"))
                kept = words
                if hi > lo:
                    gone = covered(np.flatnonzero(np.isin(windows(hashed(words, cache), width)[1], flags[lo:hi])), len(words), width)
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    spans = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                made["n_words"].append(len(words))
                made["n_removed"].append(len(words) - len(kept))
                made["removed"].append(spans)
                made["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
                made["kept_text"].append(None if text is None else (joined if spans else text).decode("utf-8", "surrogatepass"))
            cols = [pa.array(made[added[f.name]], f.type) if f.name in added else rows.column(f.name).cast(f.type) for f in out]
            yield pa.RecordBatch.from_arrays(cols, schema=out)

    return cut


def _applied(docs: DataFrame, width: int, added: dict[str, str], out: T.StructType) -> DataFrame:
    """``docs`` without repeated windows; ``added`` names what fills which column of ``out``."""
    if width < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    prepare(spark)
    tasks = reducers(spark)
    key, row, task, body, flags = free_names(docs, "id", "row", "task", "body", "flags")
    names = {"id": key, "row": row, "task": task, "body": body, "flags": flags}
    docs = docs.withColumn(key, F.col("doc_id").cast("long"))
    sent = docs.select(key, "text").mapInArrow(_sender(width, tasks), _SENT)
    told = sent.repartitionById(tasks, "task").mapInArrow(_judge(tasks), _SENT).select(F.col("task").alias(task), F.col("flags").alias(flags))
    carried = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], T.StructField(body, T.BinaryType()), T.StructField(task, T.IntegerType()), T.StructField(row, T.ByteType())])
    bodies = docs.mapInArrow(_bodies(tasks, names, arrow_schema(carried)), carried)
    both = bodies.unionByName(told, allowMissingColumns=True)
    return both.repartitionById(tasks, task).sortWithinPartitions(F.col(row).asc_nulls_first()).mapInArrow(_cut(width, names, added, arrow_schema(out)), out)


def dedup_substrings(docs: DataFrame, width: int = WIDTH, text: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the repeated windows taken out.

    Adds n_words, n_removed, removed (word intervals, maximal and disjoint),
    kept_sha256 of the kept words joined by one space, and, unless ``text`` is
    false, kept_text: the original where nothing is removed, else those words.
    """
    docs = docs.drop(*[c for c in docs.columns if c in ADDED])
    extra = [f for f in T._parse_datatype_string(_ADDED).fields if text or f.name != "kept_text"]
    out = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], *extra])
    return _applied(docs, width, {f.name: f.name for f in extra}, out)


def cut_texts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with each text replaced by what is kept of it; all other columns stay."""
    return _applied(docs, width, {"text": "kept_text"}, docs.schema)
