"""Substring removal, n-gram join, packing, chat, decontamination: edge cases and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelfcast.llm import chat, decontaminate, ngram_join, packing, substring
from shelfcast.llm.common import WordHashes, hashed, rolling
from shelfcast.llm.queries import tokenizer_path

DOC = "doc_id long, text string"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))


def texts(seed=3, n=40):
    """Documents with shared passages, copies, near copies and repeats."""
    r = random.Random(seed)
    words = [f"t{i}" for i in range(400)]
    shared = [[r.choice(words) for _ in range(30)] for _ in range(3)]
    out = []
    for _ in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, 80))]
        if r.random() < 0.5:
            k = r.randint(0, len(w))
            w[k:k] = r.choice(shared)
        out.append(" ".join(w))
    out[5] = out[4]
    out[8] = out[7].replace("t", "t", 1) + " tail"
    return out


def test_rolling_hash_depends_on_the_window_only():
    cache = WordHashes()
    a = hashed([b"a", b"b", b"c", b"d", b"e", b"a", b"b", b"c"], cache)
    h = rolling(a, 3)
    assert len(h) == 6 and h[0] == h[5] and len(set(h.tolist())) == 5
    assert len(rolling(a, 9)) == 0 and len(rolling(a, 8)) == 1


def brute_cut(rows, width):
    own, words = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        words.append(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                own[key] = min(own.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and own[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def test_substrings_match_brute_force(spark):
    rows = list(enumerate(texts())) + [(100, None), (101, ""), (102, " \n\t"), (None, texts()[4]), (103, LONG), (104, LONG), (4, texts()[4]), (7, "other text " * 20)]
    df = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], DOC + ", n_words string, lang int").repartition(3)
    out = substring.dedup_substrings(df)
    got = out.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_cut(rows, 13)
    assert out.columns == ["doc_id", "lang", "n_words", "n_removed", "removed", "kept_sha256", "kept_text"]
    for r in got:
        assert sum(x.stop - x.start for x in r.removed) == r.n_removed
    assert {r.doc_id: r.kept_text for r in got}[100] is None
    assert substring.dedup_substrings(spark.createDataFrame([], DOC)).count() == 0
    # the texts alone are cut; columns of any name keep their values
    odd = spark.createDataFrame([(i, t, "kept", 7, "row", "id") for i, t in rows], DOC + ", n_words string, __lang int, row string, id string").repartition(3)
    cut = substring.cut_texts(odd)
    assert cut.schema == odd.schema
    assert sorted((r.doc_id or -1, r.text or "") for r in cut.collect()) == sorted((r.doc_id or -1, r.kept_text or "") for r in got)
    assert {tuple(r)[2:] for r in cut.collect()} == {("kept", 7, "row", "id")}


def test_substring_packing_of_hashes():
    d = np.array([-5, -5, 3, 2**40], np.int64)
    v = np.array([1, 2**50, 7, 2**56 - 1], np.uint64)
    a, b = substring.unpack(substring.pack(d, v, 7), 7)
    assert a.tolist() == d.tolist() and b.tolist() == v.tolist()


def test_windows_are_told_apart_by_their_checks():
    name = np.array([7, 7, 3, 7, 7], np.uint64)
    check = np.array([1, 2, 1, 1, 2], np.uint8)
    order, start = substring.same_windows(name, check)
    assert [sorted(x.tolist()) for x in np.split(order, start[1:])] == [[2], [0, 3], [1, 4]]


@pytest.mark.parametrize("copies", [40, 400])
def test_answers_follow_tasks_and_documents_not_mappers_or_copies(spark, copies):
    """The rows between hash tasks and document tasks, for few and many of each."""
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:30], f"own{i}", *base[30:]])) for i in range(copies)] + [(5000 + i, " ".join(f"u{i}x{k}" for k in range(60))) for i in range(50)]

    def answers(mappers, tasks):
        sent = spark.createDataFrame(rows, DOC).repartition(mappers).mapInArrow(substring._sender(13, tasks), substring._SENT)
        return sent.repartitionById(tasks, "task").mapInArrow(substring._judge(tasks), substring._SENT).count()

    few, many = answers(2, 4), answers(32, 4)
    assert few <= 16 and many <= 16
    pairs = copies * 61
    assert answers(2, 64) <= min(64 * 64, pairs)


def brute_join(rows, n=5, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        k = min(n, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    links = defaultdict(set)
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= threshold:
                links[x].add(y)
                links[y].add(x)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[i] = (min(seen), len(links[i]))
    return out


def near_texts():
    r = random.Random(1)
    words = [f"n{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(120)]
        for c in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(c):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows) + 10 * g, " ".join(w)))
    return rows


def test_jaccard_join_matches_brute_force(spark):
    rows = near_texts() + [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "one two three"), (905, LONG), (906, LONG + " end")]
    want = brute_join(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows + rows[:2]] + [(None, "one two", "x")], DOC + ", class_id string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(df).collect()}
    assert got == want
    kept = ngram_join.keep_one(df.filter("doc_id is not null"))
    assert kept.columns == ["doc_id", "text", "class_id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, (c, _) in want.items() if c == i}
    assert ngram_join.jaccard_join(spark.createDataFrame([], DOC)).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    from shelfcast.llm import graph

    monkeypatch.setattr(graph.link_groups, "__defaults__", (7,))
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base[:150] + [f"own{i}"] + base[150:])) for i in range(40)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_join(rows)


def test_rows_that_repeat_an_id_are_members_each(spark):
    r = random.Random(8)
    a, b, c = (" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a + " end"), (2, b), (3, c), (3, None), (4, b), (3, c), (5, ""), (None, a)]
    kept = Counter((x.doc_id, x.text) for x in ngram_join.keep_one(spark.createDataFrame(rows, DOC)).collect())
    # the near copy of 1 goes, b stays once under its smallest id, rows that repeat id and text stay together
    assert kept == Counter([(1, a), (2, b), (3, c), (3, c), (3, None), (5, ""), (None, a)])


def test_bands_reach_the_recall():
    for t in (0.8, 0.9):
        b, r = ngram_join.bands_for(t, 0.999)
        assert 1 - (1 - t**r) ** b >= 0.999 and b * r <= 128


def simple_best_fit(lengths, cap):
    """Items one by one, longest first, into the bin with the smallest residual norm."""
    c = cap.vector()
    bins = []
    for x in sorted(lengths, reverse=True):
        item = np.array([x, 1, x * x])
        fits = [(np.sqrt((((b - item) / c) ** 2).sum()), k) for k, b in enumerate(bins) if (b >= item).all()]
        if fits:
            bins[min(fits)[1]] -= item
        else:
            bins.append(c - item)
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("cap", [packing.Capacity(64), packing.Capacity(64, 3), packing.Capacity(64, 8, 64 * 40)])
def test_plans_respect_every_capacity(rule, cap):
    r = random.Random(2)
    lengths = [min(r.randint(1, 64), r.randint(1, 64)) for _ in range(700)]
    if cap.cost:
        lengths = [x for x in lengths if x * x <= cap.cost]
    runs = packing.plan(Counter(lengths), cap, rule=rule)
    load, seen = defaultdict(list), Counter()
    for length, _, n, many, first, offset in runs.tolist():
        for j in range(n):
            load[first + j // many].append((offset + j % many * length, length))
            seen[length] += 1
    assert seen == Counter(lengths)
    limit = cap.vector()
    for items in load.values():
        at = 0
        for o, x in sorted(items):
            assert o == at
            at += x
        assert (np.array([at, len(items), sum(x * x for _, x in items)]) <= limit).all()
    if rule == "norm":
        assert len(load) <= simple_best_fit(lengths, cap) * 1.02 + 1


def test_ids_are_the_tokenizers():
    c = packing.PartIds(tokenizer_path())
    r = random.Random(5)
    signs = [*"aBÉßñ'’ .,!\t\n\x0b\x1c\x85\xa0µº×1_<|>Σσ́🙂", "'s", "<|endoftext|>", "</w>", "the", "İ"]
    rows = ["".join(r.choice(signs) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for t, got in zip(rows, c.encode(rows), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == c.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_of_a_table(spark):
    rows = list(enumerate(texts())) + [(100, None), (101, ""), (102, LONG), (102, LONG), (None, "a b")]
    df = spark.createDataFrame([(*x, 1) for x in rows], DOC + ", offset int").repartition(3)
    got = packing.pack(df, tokenizer_path(), packing.Capacity(256), keep_ids=True).collect()
    tok = packing.PartIds(tokenizer_path()).tokenizer
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[a : a + 256], "<u4").tobytes()
            want[i, k, a, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    load = defaultdict(list)
    for r in got:
        load[r.sequence_id].append((r.offset, r.length))
    for items in load.values():
        at = 0
        for o, x in sorted(items):
            assert o == at
            at += x
        assert at <= 256
    assert len(load) <= 1.05 * sum(r.length for r in got) / 256 + 1
    assert packing.pack(spark.createDataFrame([], DOC), tokenizer_path()).count() == 0


def test_escaping_is_reversible():
    r = random.Random(4)
    parts = ["<|", "<", "|", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\n", "<|end|>\n", "<|turn|>", "a", "é"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        turns = [(t, t), ("assistant", t[::-1])]
        out = chat.turn_template(turns)
        assert chat.parse(out) == turns
        got = chat.render_incrementally(turns, chat.turn_template)
        assert got.text == out and not got.rewrites
        assert [chat.unescape(out[a:b]) for a, b in got.content] == [t, t[::-1]]


def test_rewritten_history_is_found():
    def forgetful(turns):
        return "".join(f"[{r}]{'' if k < len(turns) - 1 and r == 'think' else t}." for k, (r, t) in enumerate(turns))

    got = chat.render_incrementally([("user", "hi"), ("think", "hm"), ("assistant", "yes")], forgetful)
    assert [k for k, _ in got.rewrites] == [2] and got.text == "[user]hi.[think].[assistant]yes."


def test_prefixes_are_rendered_once_each():
    seen = []

    def template(turns):
        seen.append(len(turns))
        return chat.turn_template(turns)

    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(300)]
    got = chat.render_incrementally(turns, template)
    assert sum(n > 2 for n in seen) == 298 and [got.text[a:b] for a, b in got.content] == [t for _, t in turns]

    # a template whose spans depend on all turns before is probed on whole prefixes
    def counting(turns):
        return "".join(f"{k}:{t};" for k, (_, t) in enumerate(turns))

    got = chat.render_incrementally(turns[:12], counting)
    assert [got.text[a:b] for a, b in got.content] == [t for _, t in turns[:12]]


def test_conversations(spark):
    rows = [(1, 1, "assistant", "x"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, 0, None, "[INST]"), (None, 0, "user", "q"), (3, 0, "assistant", ""), (1, None, "system", "s"), (1, 0, "user", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, spans int")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 5 and got[1].turns_sha256 == sha("system\ns\nuser\n\nuser\n\nassistant\na\nassistant\nx\n")
    assert got[1].loss_sha256 == sha("ax") and got[1].loss_chars == 2
    assert got[2].turns_sha256 == sha("\n[INST]\n") and got[3].loss_chars == 0 and None in got
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


ITEM = "item_id long, text string"


def bench_items(n=60):
    r = random.Random(9)
    words = [f"q{i}" for i in range(500)]
    return [(i, " ".join(r.choice(words) for _ in range(r.randint(12, 25))) + ". " + " ".join(r.choice(words) for _ in range(8)) + ".") for i in range(n)]


def full_scores(ix, terms):
    full = np.zeros(len(ix.items))
    for t in terms:
        np.add.at(full, ix.item[ix.start[t] : ix.start[t + 1]], ix.share[ix.start[t] : ix.start[t + 1]])
    return full


@pytest.mark.parametrize("block", [2, 32])
def test_wand_returns_what_full_scoring_returns(monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items = bench_items(300)
    bags = [decontaminate.words_of(t) for _, t in items]
    counts = Counter(w for b in bags for w in set(b))
    ix = decontaminate.build(items, len(bags), sum(map(len, bags)) / len(bags), counts)
    r = random.Random(10)
    found = 0
    for k in range(300):
        words = set(r.sample(bags[k], 10) + r.sample(bags[(k * 7) % 300], len(bags[(k * 7) % 300]) - r.randint(0, 9)))
        terms = sorted(ix.terms[w] for w in words)
        full = full_scores(ix, terms)
        got = dict(decontaminate.wand(ix, terms))
        assert set(got) == set(np.flatnonzero(full >= decontaminate.ENOUGH).tolist())
        assert all(abs(full[k] - s) < 1e-9 for k, s in got.items())
        found += len(got)
    assert found > 100
    # a share of 1 is the threshold on the plain BM25 score
    k, bag = 5, Counter(bags[5])
    norm = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(bags[5]) / (sum(map(len, bags)) / len(bags)))
    own = sum(np.log1p((300 - counts[w] + 0.5) / (counts[w] + 0.5)) * tf * (decontaminate.K1 + 1) / (tf + norm) for w, tf in bag.items())
    assert ix.threshold[k] == pytest.approx(decontaminate.RETRIEVE * own)


def brute_leaks(docs, items):
    """(doc, item) pairs: every passage against every item, in full."""
    items = [(i, t) for i, t in items if i is not None and decontaminate.words_of(t)]
    bags = [decontaminate.words_of(t) for _, t in items]
    df, mean = Counter(w for b in bags for w in set(b)), sum(map(len, bags)) / len(bags)
    out = set()
    size = {}
    for b in bags:
        c = max(4, (len(b) - 1).bit_length())
        size[c] = max(size.get(c, 0), 2 * len(b))
    for d, t in docs:
        words = decontaminate.words_of(t)
        if d is None or not words:
            continue
        for (i, text), bag in zip(items, bags, strict=True):
            norm = 1.2 * (0.25 + 0.75 * len(bag) / mean)
            add = {w: np.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + norm) for w, tf in Counter(bag).items()}
            n = size[max(4, (len(bag) - 1).bit_length())]
            for a in range(0, max(1, len(words) - n // 2), n // 2):
                there = words[a : a + n]
                if sum(add[w] for w in set(there) if w in add) >= 0.6 * sum(add.values()) - 1e-9:
                    parts = decontaminate.question_and_answer(text)
                    if all(decontaminate.overlap(p, there) >= 0.8 for p in parts):
                        out.add((d, i))
    return out


def test_leaks_are_found_and_clean_documents_left(spark, monkeypatch):
    items = bench_items()
    filler = [f"f{i} q{i}" for i in range(300)]
    docs = [(k, " ".join(filler[k : k + 60]) + "\n" + t.upper() + "\n" + " ".join(filler[100 : 100 + k])) for k, t in items[:20]]
    docs += [(100 + k, " ".join(filler[k : k + 150])) for k in range(20)] + [(200, None), (201, ""), (None, items[0][1]), (0, docs[0][1]), (202, LONG + " " + items[3][1])]
    half = items[5][1].split()
    docs.append((203, " ".join(half[: len(half) // 2])))
    want = {(k, k) for k in range(20)} | {(202, 3)}
    df = spark.createDataFrame([(*d, 1) for d in docs], DOC + ", bm25 int").repartition(3)
    bench = spark.createDataFrame([*items, (999, None), (998, "!"), (None, "a b c")], ITEM)
    got = decontaminate.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} - {None}
    # parts of words changed, of each document in turn
    r = random.Random(3)
    noisy = [(300 + k, " ".join(w if r.random() > k / 100 else "zz" for w in t.split())) for k, (_, t) in enumerate(items)]
    noisy += [(400 + k, t.split(". ")[0] + " qq " * 3 + t.split(". ")[1]) for k, t in items[:9]]
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame(docs + noisy, DOC), bench).collect()} == brute_leaks(docs + noisy, items)
    with monkeypatch.context() as m:
        m.setattr(decontaminate, "PART_CHARS", 2000)
        assert len(list(decontaminate.indexes(bench))) > 1
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()} == want
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0
    # an item of many words has passages of its own; those of the others stay short
    lengths = [ix.passage for ix in next(decontaminate.indexes(spark.createDataFrame([*items, (500, LONG[:60_000])], ITEM)))]
    assert len(lengths) > 1 and min(lengths) < 100 < 5000 < max(lengths)
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(spark.createDataFrame([(1, LONG)], DOC), spark.createDataFrame([(500, LONG[:60_000])], ITEM)).collect()} == {(1, 500)}


def test_a_benchmark_of_20000_items_is_one_pass(spark):
    r = random.Random(6)
    words = [f"k{i}" for i in range(30_000)]
    items = [(i, " ".join(r.choice(words) for _ in range(50)) + ". " + " ".join(r.choice(words) for _ in range(8))) for i in range(20_000)]
    bench = spark.createDataFrame(items, ITEM)
    (built,) = decontaminate.indexes(bench)
    assert sum(len(ix.items) for ix in built) == 20_000 and sum(len(ix.item) for ix in built) < 20_000 * 58
    docs = [(k, " ".join(r.choice(words) for _ in range(150)) + " " + items[k * 400][1] + " " + " ".join(r.choice(words) for _ in range(150))) for k in range(40)]
    docs += [(100 + k, " ".join(r.choice(words) for _ in range(500))) for k in range(20)]
    got = {(x[0], y[0]) for x in docs for y in decontaminate.leaks_in(built, x[1])}
    assert got == {(k, k * 400) for k in range(40)}


def test_of_equal_passages_the_first_is_told(spark):
    item = "which river of the northern plain has the most islands in spring and where does it end: in the lake of seven stones"
    filler = " ".join(f"f{i}" for i in range(90))
    rows = [(1, f"{item} {filler}"), (1, f"{filler} {item}"), (2, f"{filler} {item} {filler} {item}"), (None, f"{filler} {item}")]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, DOC), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    firsts = {r.doc_id: r.first_word for r in got}
    assert firsts[1] == 0 and firsts[2] <= 90 and len(got) == len(firsts)
