"""Filter audit, spelling variants and syncmer fingerprints against brute force."""

import hashlib
import random
from collections import Counter
from itertools import permutations
from zlib import crc32

import pytest
import xxhash
from shelfcast.llm import audit, syncmers, variants
from shelfcast.llm.common import stored

DOCS = "doc_id long, text string, source string"


def _edits(x, y):
    """Whether one code point inserted, deleted or replaced makes one of the other."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return x[k + 1 :] == y[k + 1 :] or x[k:] == y[k + 1 :] or x[k + 1 :] == y[k:]


def _brute_variants(rows):
    import re

    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [v for v in words if _edits(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def _vocabulary_rows(seed=3):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    words = []
    for s in stems:
        words += [s] * rng.choice([2, 30, 400])
        for _ in range(6):
            k = rng.randrange(len(s))
            words += [rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("abcÉ") + s[k:], s[:k] + rng.choice("abcd") + s[k + 1 :]])] * rng.choice([1, 2, 3, 25])
    rng.shuffle(words)
    rows = [(i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words[i * 40 : i * 40 + 40])) for i in range(len(words) // 40 + 1)]
    long_run = "z" * 3000
    return [*rows, (None, "aaaaaaa bbbbbbbb-aaaaaaa"), (7, None), (8, ""), (9, "Straße_lang1naïveté x÷y×zabc"), (9, "Straße_lang1naïveté x÷y×zabc"), (900, f"{long_run} {long_run} {long_run}q {long_run}q")]


@pytest.mark.parametrize("most", [variants.PART_CHARS, 40])
def test_variants_equal_brute_force(spark, most):
    rows = _vocabulary_rows()
    got = variants.variants(spark.createDataFrame(rows, "doc_id long, text string"), most).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == _brute_variants(rows)
    assert len(got) == len({r.word for r in got}) > 100 and any(r.form and r.root != r.form for r in got)


def test_no_part_holds_more_than_it_may(spark):
    words = spark.createDataFrame([(f"common{a}{b}{c}", 2) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"], "word string, n long")
    got = variants.parts(words, 100).selectExpr("key", "b - a AS span").groupBy("key", "span").count().collect()
    assert all(r["count"] * r.span <= 100 or r.span == 1 for r in got)
    near = {r.word: r.n_near for r in variants.near_words(stored(words, "t"), 100).collect()}
    assert len(near) == 512 and set(near.values()) == {21}


def test_pairs_of_a_trie():
    words = ["", "a", "b", "ab", "ba", "abc", "abcd", "xbcd", "abd"]
    want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if _edits(x, y)}
    got = list(variants.trie_join(words))
    assert set(got) == want and len(got) == len(want)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string, n long, form string")
    assert variants.variants(empty).collect() == []
    none = spark.createDataFrame([(1, None), (2, "short words")], "doc_id long, text string")
    assert variants.variants(none).collect() == []


def _brute_audit(docs, labels):
    good, toxic = Counter(), Counter()
    for i, q, t in labels:
        good[i], toxic[i] = max(good[i], q == 1), max(toxic[i], t == 1)
    facts = []
    for i, text, source in docs:
        text = text or ""
        words = [w for w in __import__("re").split("[ \t\n\x0b\x0c\r]+", text) if w]
        copy = i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in docs)
        capitals = sum("A" <= c <= "Z" for c in text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}
        facts.append((source or "", fails, good[i] if i is not None else 0, toxic[i] if i is not None else 0))
    out = {}
    for part in {p for p, *_ in facts}:
        mine = [x for x in facts if x[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = [x for x in mine if not any(x[1][g] for g in order[:k])]
                gone = [x for x in before if x[1][f]]
                shapley[f] += len(gone)
                out[part, order, k + 1] = [len(before) - len(gone), len(gone), sum(x[1][f] for x in mine) - len(gone), sum(x[1][f] and not any(x[1][g] for g in "ABCDE" if g != f) for x in mine), sum(bool(x[2]) for x in gone), sum(bool(x[3]) for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def _audit_rows():
    rng = random.Random(5)
    docs = []
    for i in range(120):
        words = [rng.choice(["red", "Blue", "x#", "GREEN", "a", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 5, 150, 199, 200, 260]))]
        docs.append((i, rng.choice([" ", "\n", "\x0b"]).join(words), rng.choice(["s1", "s1", "s1", "s2", None])))
    docs += [(500 + k, docs[7][1], "s3") for k in range(5)] + [(500, docs[7][1], "s3"), (None, docs[7][1], "s1"), (600, None, "s2"), (601, "", ""), (602, "word\xa0joined " * 100, "s2"), (603, "é" * 50_000, "s4")]
    labels = [(i, i % 3 % 2, i % 5 == 0) for i in range(0, 130, 2)] + [(4, 1, True), (6, None, None), (None, 1, True)]
    return docs, [(i, q, None if t is None else int(t)) for i, q, t in labels]


def test_audit_equals_brute_force(spark):
    docs, labels = _audit_rows()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS + ", part string, bits int")
    got = audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = _brute_audit(docs, labels)
    assert {(r.part, r.filter_order, r.step): [r[c] for c in (*audit.COUNTS, "shapley")] for r in got} == want
    assert len(got) == len(want) == 5 * 600


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), labels).collect() == []
    one = audit.audit(spark.createDataFrame([(None, None, None)], DOCS), labels)
    assert one.count() == 600 and {r.part for r in one.collect()} == {""}


def _brute_anchors(data):
    """(position, hash) of each closed syncmer of a text, by definition."""
    k, s = syncmers.K, syncmers.S
    padded = bytes(k - 1) + data
    order = lambda x: (0, 0) if not any(x) and x else (1, xxhash.xxh64_intdigest(x, 42) - (1 << 64) * (xxhash.xxh64_intdigest(x, 42) >> 63))
    out = []
    for i in range(len(padded) - k + 1):
        inner = [order(padded[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, xxhash.xxh64_intdigest(padded[i : i + k], 42)))
    return out


def _brute_print(text):
    cells = {}
    for i, h in _brute_anchors(text.encode()):
        cells[h & 63] = min(cells.get(h & 63, (1 << 33, 0)), (h >> 32, i))
    return {c: h for c, (h, _) in cells.items()}


def _brute_likeness(a, b):
    return 1.0 if not a and not b else sum(a.get(c) == b.get(c) for c in a.keys() & b.keys()) / len(a.keys() | b.keys())


def _texts():
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["eau", "réti", "onna", "the", "of", "ing", "日本", "🙂"]) + rng.choice(["x", "yy", ""]) for _ in range(n))
    rows = [(i * 3, prose(rng.choice([0, 1, 2, 5, 40, 300]))) for i in range(40)]
    rows += [(200, "z" * 5000), (201, "z" * 5001), (202, prose(8000)), (203, rows[20][1]), (204, None), (205, ""), (206, "abc"), (207, "abcd"), (None, "without an id " * 9), (None, None), (30, rows[10][1]), (30, "another of the same id " * 7), (10**17 + 1, "large id " * 30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_fingerprints_equal_brute_force(spark, partitions):
    rows = _texts()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = syncmers.fingerprints(spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "doc_id long, text string, place int, range string, n_chars int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((i is not None, i or 0, t or "", i) for i, t in rows), key=lambda x: (x[0], x[1], x[2].encode()))
    want = []
    for k, (_, _, text, i) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut]
        a, b, c = _brute_print(text), _brute_print(changed), _brute_print(following)
        shown = lambda p: "".join(f"{h * 64 + c:010x}" for c, h in sorted(p.items()))
        want.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), shown(a), shown(b), round(_brute_likeness(a, b), 9), round(_brute_likeness(a, c), 9)))
    told = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    key = lambda r: (r[0] is not None, *map(str, r))
    assert sorted(told, key=key) == sorted(want, key=key)


def test_fingerprints_of_little(spark):
    docs = "doc_id long, text string"
    assert syncmers.fingerprints(spark.createDataFrame([], docs)).collect() == []
    one = syncmers.fingerprints(spark.createDataFrame([(5, "alone in the table")], docs)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].moved_next == 0
    text = " ".join(f"word{i}" for i in range(300))
    two = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame([(1, text), (2, "Some forty letters are put before it all: " + text)], docs)).collect()}
    assert two[1].near_next > 0.8 and two[1].moved_next == 42


def test_fingerprints_run_no_python(spark, monkeypatch):
    df = syncmers.fingerprints(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
