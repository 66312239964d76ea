"""Spelling variants: words one edit apart, found by joining a trie with itself.

Method
  A trie-join: a walk down the trie of the vocabulary carries, at each node, the
  active nodes, those whose string is within one edit of the node's own. The
  active nodes of a child follow from those of its parent: the parent (its letter
  deleted), its other children (replaced), the child's children (inserted), and
  from each active node at distance one its child by the same letter. Words that
  end at an active node of a word's end are its near words.

  The trie is cut into parts by prefixes. Two words one edit apart, the longer of
  length c, differ first at a place e below c: they share what stands before e, and what
  follows. With the places cut into intervals [a, b), a pair whose place lies in
  one shares the first a code points and the last c - b, so both words are in the
  part with that prefix and that suffix, where only the middles make a trie. A word is in one part for
  each of its two lengths c and each interval; the part of the pair's own
  interval, and no other, emits it.

Layout for scale
  Words are counted in tasks before they are shuffled. Intervals start as halves, and those of parts
  with over PART_CHARS code points are halved again until none is left: a part
  whose interval is one place has a word a letter at most. So a task's memory is
  bounded however many words share a prefix, and a word is never sent to more parts than
  its two lengths have intervals. What leaves a part is one row a word: its number
  of near words and the best of them, not pairs. Forms are followed to their end by doubling.

Defined results
  Null texts have no words. A null id counts as the empty string before the colon.
  Repeated rows count each time. A form has ten times the count of its word, so
  forms never lead in a circle. Empty tables give empty ones. Columns but doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, forget, prepare, reducers, stored

C = F.col
#: Fixed values of the contract: shortest word, fewest occurrences, how often a word
#: loses a letter, how many times as frequent a form is.
LEAST, OCCURS, EVERY, TIMES = 7, 2, 31, 10
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Code points of the middles in one part, above which its interval is halved.
PART_CHARS = 1_000_000
#: Different words that a mapper holds before it passes their counts on.
HELD = 200_000


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a text with their occurrences: long runs, a letter lost where the hash says so."""
    if not text:
        return Counter()
    runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
    start = crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    out: Counter = Counter()
    for run, n in runs.items():
        h = crc32(run.encode(), start)
        if h % EVERY == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < LEAST:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: words of LEAST code points with OCCURS occurrences at least."""
    prepare(docs.sparkSession)
    schema = arrow_schema("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.update(words_of(doc_id, text))
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    counts = docs.select(C("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(C("n") >= OCCURS)


def _placed(words: DataFrame, c: Column, a: Column, b: Column) -> Column:
    """What names the part of a word for pairs of length ``c`` and places [a, b)."""
    size = F.length("word")
    head, tail = F.substring("word", F.lit(1), a), F.substring("word", size - (c - b) + 1, c - b)
    return F.concat_ws("\n", c.cast("string"), a.cast("string"), b.cast("string"), head, tail)


def parts(words: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """key, c, a, b, word, n: each word in the parts of its lengths and intervals."""
    size = F.length("word")
    lengths = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("c"))
    half = F.floor(C("c") / 2).cast("int")
    spans = F.array(F.struct(F.lit(0).alias("a"), half.alias("b")), F.struct(half.alias("a"), C("c").alias("b")))
    rows = lengths.select("word", "n", "c", F.explode(spans).alias("_s")).select("word", "n", "c", "_s.a", "_s.b")
    key = _placed(rows, C("c"), C("a"), C("b"))
    rows = stored(rows.select(key.alias("key"), "c", "a", "b", "word", "n"), "variant-parts")
    done: DataFrame | None = None
    while True:
        big = rows.groupBy("key", "a", "b").agg(F.sum(C("b") - C("a")).alias("chars"), F.count("*").alias("n_words")).filter((C("chars") > most) & (C("n_words") > 1) & (C("b") - C("a") > 1)).select("key")
        big = stored(big, "variant-big")
        if big.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(big, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        mid = F.floor((C("a") + C("b")) / 2).cast("int")
        spans = F.array(F.struct(C("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), C("b").alias("b")))
        halves = rows.join(big, "key", "left_semi").select("word", "n", "c", F.explode(spans).alias("_s")).select("word", "n", "c", "_s.a", "_s.b")
        rows = stored(halves.select(_placed(halves, C("c"), C("a"), C("b")).alias("key"), "c", "a", "b", "word", "n"), "variant-parts")


def trie_join(middles: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of different strings at one edit, each pair in both orders."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for i, m in enumerate(middles):
        at = 0
        for letter in m:
            nxt = children[at].get(letter)
            if nxt is None:
                nxt = children[at][letter] = len(children)
                children.append({})
                ends.append(-1)
            at = nxt
        ends[at] = i
    active = set(children[0].values())
    stack = [(0, active)]
    while stack:
        node, active = stack.pop()
        if ends[node] >= 0:
            for other in active:
                if ends[other] >= 0:
                    yield ends[node], ends[other]
        below = children[node]
        for letter, child in below.items():
            near = {node}
            near.update(below.values())
            near.update(children[child].values())
            for other in active:
                kept = children[other].get(letter)
                if kept is not None:
                    near.add(kept)
            near.discard(child)
            stack.append((child, near))


def _agree(x: str, y: str) -> int:
    n = 0
    for p, q in zip(x, y, strict=False):
        if p != q:
            break
        n += 1
    return n


def near_words(words: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """word, n_near, best: number of near words, and (-n, word) of the most frequent one."""
    prepare(words.sparkSession)
    spec = "word string, n_near long, best_n long, best string"
    schema = arrow_schema(spec)

    def joined(c: int, a: int, b: int, found: list[tuple[str, int]]) -> list[tuple[str, int, int, str]]:
        best: dict[int, tuple[int, int, str]] = {}
        names = [w for w, _ in found]
        for i, j in trie_join([w[a : len(w) - (c - b)] for w in names]):
            x, y = names[i], names[j]
            if max(len(x), len(y)) != c or _agree(x, y) >= b:
                continue  # another length's or interval's pair
            n, m, word = best.get(i, (0, 0, ""))
            if (-found[j][1], y) < (-m, word) or not n:
                m, word = found[j][1], y
            best[i] = (n + 1, m, word)
        return [(names[i], *v) for i, v in best.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        key, at = None, (0, 0, 0)
        out: list[tuple[str, int, int, str]] = []

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return got

        for rows in batches:
            for k, c, a, b, word, n in zip(*[rows.column(x).to_pylist() for x in ("key", "c", "a", "b", "word", "n")], strict=True):
                if k != key:
                    if len(held) > 1:
                        out += joined(*at, held)
                        if len(out) > 10_000:
                            yield batch()
                    held, key, at = [], k, (c, a, b)
                held.append((word, n))
        if len(held) > 1:
            out += joined(*at, held)
        if out:
            yield batch()

    dealt = parts(words, most).repartition(reducers(words.sparkSession), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(run, spec)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-C("best_n")).alias("less"), C("best").alias("word"))).alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root: the last of the chain word, form, form of the form, and so on.

    Each round doubles the steps that are taken; counts grow tenfold a step, so
    the rounds are the logarithm of a logarithm of the largest count.
    """
    at = stored(forms.select("word", C("form").alias("root")), "variant-roots")
    while True:
        step = at.select(C("word").alias("root"), C("root").alias("_further"))
        got = stored(at.join(step, "root", "left").select("word", F.coalesce("_further", "root").alias("root"), C("_further").isNotNull().alias("_went")), "variant-roots")
        forget(at)
        at = got.select("word", "root")
        if got.filter("_went").isEmpty():
            return at


def variants(docs: DataFrame, most: int = PART_CHARS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    words = stored(vocabulary(docs), "variant-words")
    near = near_words(words, most)
    rows = words.join(near, "word", "left")
    better = -C("best.less") >= TIMES * C("n")
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, C("best.word")).alias("form"), F.when(better, -C("best.less")).alias("form_n")), "variant-forms")
    roots = followed(rows.filter(C("form").isNotNull()))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
