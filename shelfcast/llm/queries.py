"""Driver queries of the subpackage and the SQL that states their rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, chat, compaction, decontaminate, itq, lm, ngram_join, packing, quality, substring, syncmers, toxicity, variants
from .common import read, shared_dir
from .learn import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs, text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # a document has one token at least, and squared lengths sum to no more than
    # the squared sum: neither of these two capacities costs a sequence
    capacity = packing.Capacity(tokens=4096, documents=4096, cost=4096**2)
    return packing.pack(docs, tokenizer_path(), capacity)


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


SQL["op4_chat_formatting"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *,
    length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<\||<s>|</s>|\[INST\]|\[/INST\]')) AS text_chars,
    length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '<\||<s>|</s>|\[INST\]|\[/INST\]')) + length(role) - length(replace(role, chr(10), '')) AS role_chars
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(role_chars + text_chars + 8 + 1 + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


@query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))


@query
def op1_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "spans")


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return lm.cross_entropy_difference(docs, F.col("source") == "src0")


#: Arrivals that the table comes in, in the query below.
ARRIVALS = 4


@query
def op10_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows read back from the last version after every arrival and compaction."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    store = compaction.ShardStore(spark, f"{shared_dir(spark)}/shelfcast/store-{uuid.uuid4().hex}")
    for k in range(ARRIVALS):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


SQL["op10_size_tiered_compaction"] = """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, read(spark, sf_dir, "labels"))


SQL["op12_filter_audit"] = r"""
WITH facts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(words) < 200 AS INTEGER)
    + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
    + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INTEGER)
    + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS INTEGER) AS bits
  FROM facts LEFT JOIN marks USING (doc_id)
), filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier
  FROM orders, (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step)
), counts AS (
  SELECT part, bit, earlier,
    count(*) FILTER (bits & (earlier | bit) = 0) AS kept,
    count(*) FILTER (bits & bit > 0 AND bits & earlier = 0) AS removed,
    count(*) FILTER (bits & bit > 0 AND bits & earlier > 0) AS redundant,
    count(*) FILTER (bits = bit) AS unique_fails,
    count(*) FILTER (bits & bit > 0 AND bits & earlier = 0 AND good) AS good_lost,
    count(*) FILTER (bits & bit > 0 AND bits & earlier = 0 AND toxic) AS toxic_lost
  FROM fails, (SELECT DISTINCT bit, earlier FROM steps) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counts JOIN steps USING (bit, earlier)
"""


@query
def op13_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(read(spark, sf_dir, "documents"))
