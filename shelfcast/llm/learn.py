"""What the trained operators share: labelled samples, folds, scoring passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, first_by_hash, prepare

#: Labelled documents a model is fitted on, at most: the first by a hash of the id.
SAMPLE = 20_000
#: Fold of crc32(doc_id) modulo 4 whose labels are never seen.
FOLDS, HELD = 4, 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of a bounded sample of training rows.

    The sample has at most ``rows`` ids, so its broadcast is bounded, and one
    row an id: the smallest text, however many rows repeat the id. Null ids and
    labels teach nothing; an id with several labels has their maximum.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    picked = first_by_hash(picked, rows, "doc_id")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def add_columns(docs: DataFrame, make: Callable[[list], dict[str, list]], added: str) -> DataFrame:
    """``docs`` with columns that ``make`` derives from a batch of texts.

    Columns of ``docs`` with the names of new ones are replaced.
    """
    prepare(docs.sparkSession)
    new = T._parse_datatype_string(added)
    names = {f.name for f in new}
    docs = docs.drop(*[c for c in docs.columns if c in names])
    out = T.StructType([*docs.schema.fields, *new.fields])
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = make(batch.column("text").to_pylist())
            cols = [pa.array(got[f.name], f.type) if f.name in names else batch.column(f.name).cast(f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(run, out)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a logistic regression, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * max(1, len(x)))
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
