"""The pipeline against a brute-force one, and on tables with nothing in them."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import packing, quality
from shelfcast.llm.queries import tokenizer_path

from test_learned_operators import corpus
from test_text_operators import brute_join, brute_leaks

SCHEMA = "doc_id long, text string, lang string, n_chars long, score double, piece int, class_id long"
ITEM = "what is the name of this thing here now. it is called nothing at all today."


def _cut(rows, width=13):
    """Texts without the windows that a smaller id has too; others as they are."""
    own, words = {}, [(t or "").encode().split() for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                own[key] = min(own.get(key, i), i)
    out = []
    for (i, t), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and own[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        out.append((i, kept if any(gone) else t))
    return out


def _packed(rows, cap=4096):
    tok, out = packing.PartIds(tokenizer_path()).tokenizer, Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), cap)):
            part = np.array(ids[a : a + cap], "<u4")
            out[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    return out


def _put(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", len(t or ""), 0.5, 7, 3) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = corpus(160, seed=2)
    good = [t for (_, t), (_, q, _) in zip(docs, labels, strict=True) if q][:16]
    shared = " ".join(f"s{i}" for i in range(60))
    docs += [(500 + k, t) for k, t in enumerate(good)] + [(530 + k, t + " tail") for k, t in enumerate(good[:5])]
    docs += [(600, good[0] + " " + shared + "."), (601, good[1] + "\n" + shared + "."), (602, " ".join(good[2].split()[::2]) + " " + ITEM + " " + good[4]), (603, None), (604, ""), (605, "  spaced   words\tstay  as they are "), (None, good[3] + " without an id"), (606, " ".join(good) * 30)]
    folder = str(tmp_path)
    items = [(1, ITEM), (2, None), (3, "!")]
    _put(spark, folder, docs, labels, items)
    got = corpus_pipeline.run(spark, folder).collect()
    # one stage after another, each on what the one before kept
    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in quality.score(table.select("doc_id", "text"), model).filter("predicted = 1").collect()]
    assert 0 < len(rows) < len(docs)
    heads = {i: head for i, (head, _) in brute_join([x for x in rows if x[0] is not None]).items()}
    one = [(i, t) for i, t in rows if i is None or heads[i] == i]
    assert len(one) < len(rows)
    cut = _cut(one)
    assert sum(a != b for a, b in zip(one, cut, strict=True)) >= 1
    leaks = {d for d, _ in brute_leaks(cut, items)}
    left = [(i, t) for i, t in cut if i not in leaks]
    assert len(left) < len(cut)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == _packed(left)
    loads = Counter()
    for r in got:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 4096


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_of_empty_tables(spark, tmp_path, empty):
    docs, labels = corpus(30, seed=4)
    folder = str(tmp_path)
    _put(spark, folder, [] if empty == "documents" else docs, [] if empty == "labels" else labels, [] if empty == "benchmark" else [(1, ITEM)])
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[:2] == ["doc_id", "piece"]
    n = got.select("doc_id").distinct().count()
    assert (n == 0) if empty == "documents" else n > 0
    if empty == "labels":  # nothing is rejected without labels
        assert n == 30


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    docs, labels = corpus(40, seed=5)
    folder = str(tmp_path)
    _put(spark, folder, docs, labels, [(1, ITEM)])
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, folder)
        assert out.columns == table.columns, name
        assert out.filter((F.col("score") != 0.5) | (F.col("piece") != 7) | (F.col("class_id") != 3)).count() == 0
