"""Quality by a regularised quadratic discriminant over document statistics.

A text becomes a vector of transformed statistics. Each class has a Gaussian
whose covariance is shrunk, first towards the pooled covariance, then towards a
multiple of the identity (as far as its sample size calls for). A score is the
difference of the two Mahalanobis log-densities, from Cholesky factors computed
once, mapped to a probability by a logistic fit on the training rows.

The model is a few kilobytes and is fitted on a bounded sample of labelled rows;
scoring is one pass over whole texts without a shuffle.

Defined results
  Null and empty texts have the statistics of no words and are scored like any
  other; texts of any length are scored whole; an empty table gives no rows.
  Columns called score or predicted are replaced by ``score`` and kept by
  ``keep_good``. Rows that repeat an id are scored each; in the sample an id
  counts once, by its smallest text, and rows with a null id or label not at all.
  Without labelled rows nothing speaks against a text, and every text is accepted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare
from .learn import SAMPLE, add_columns, fit_logistic, labelled, sigmoid

THRESHOLD = 0.7

_BYTES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".!?",
    "bang": b"!",
    "bar": b"|",
    "sign": b"#$%&*+=<>@^_~\\/{}[]",
    "comma": b",;:",
}
_CLASS = np.zeros((256, len(_BYTES) + 2))
for _k, _v in enumerate(_BYTES.values()):
    _CLASS[list(_v), _k] = 1
_CLASS[[*range(65, 91), *range(97, 123), *range(192, 256)], len(_BYTES)] = 1  # letters; a lead byte is one
_CLASS[:128, len(_BYTES) + 1] = _CLASS[192:, len(_BYTES) + 1] = 1  # characters


#: The shares that make up a vector, each with its weight before
#: the logarithm and the units of typical text it starts from.
SHARES = [
    ("letters of words", 1, 20), ("spread of word lengths", 1, 20), ("distinct words", 20, 20), ("capitals", 50, 100),
    ("digits", 100, 100), ("sentence ends", 20, 20), ("exclamation marks", 50, 20), ("bars", 50, 20), ("signs", 50, 20),
    ("commas", 20, 20), ("lines", 100, 20), ("repeated lines", 50, 3), ("most frequent word", 50, 20),
    ("words said twice", 100, 20), ("letters", 1, 100),
]
_WEIGHT = np.array([w for _, w, _ in SHARES], float)
_UNITS = np.array([u for _, _, u in SHARES], float)


def statistics(text: str | None) -> list[float]:
    """Counts of a whole text: its words, then what each share is a share of and how much."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    upper, digit, stop, bang, bar, sign, comma, letters, chars = counts.tolist()
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = Counter(words)
    same = sum(map(eq, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.float64, n)
    parts = [
        (lengths.sum(), n), (lengths.var() * n if n else 0.0, n), (len(seen), n), (upper, letters), (digit, chars), (stop, n), (bang, n), (bar, n), (sign, n),
        (comma, n), (len(lines), n), (len(lines) - len(set(lines)), len(lines)), (max(seen.values(), default=0), n), (same, n), (letters, chars),
    ]
    return [float(n), *(float(a) for a, _ in parts), *(float(b) for _, b in parts)]


def rates_of(raw: np.ndarray) -> np.ndarray:
    """Shares of all texts together."""
    k = len(SHARES)
    return raw[:, 1 : k + 1].sum(axis=0) / np.maximum(raw[:, k + 1 :].sum(axis=0), 1)


def transformed(raw: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Vectors of texts. A share starts from some units of typical text, so a few
    words say little; it goes through a logarithm, as does the length."""
    k = len(SHARES)
    shares = (raw[:, 1 : k + 1] + _UNITS * rates) / (raw[:, k + 1 :] + _UNITS)
    return np.c_[np.log1p(raw[:, 0] + 20), np.log1p(_WEIGHT * shares)]


@dataclass(frozen=True)
class Discriminant:
    rates: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    #: Per class: inverse of the Cholesky factor of the covariance, and half its log-determinant.
    factors: np.ndarray
    half_logdet: np.ndarray
    calibration: np.ndarray

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) - h for m, f, h in zip(self.means, self.factors, self.half_logdet, strict=True)]
        return density[1] - density[0]

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Scores from counts as :func:`statistics` gives them."""
        x = transformed(raw, self.rates)
        return sigmoid(_squeezed(self.log_ratio(x)) @ self.calibration[:-1] + self.calibration[-1])


def _squeezed(ratio: np.ndarray) -> np.ndarray:
    """Signed root: far out, densities overstate what is known."""
    return (np.sign(ratio) * np.log1p(np.abs(ratio)))[:, None]


def shrunk(z: np.ndarray, pooled: np.ndarray, towards_pooled: float) -> np.ndarray:
    """Class covariance shrunk to the pooled one and to a multiple of the identity.

    The second weight is the Ledoit-Wolf estimate.
    """
    n, d = z.shape
    s = z.T @ z / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum()
    beta = max(0.0, ((z**2).sum(axis=1) ** 2).sum() / n**2 - (s**2).sum() / n)
    rho = min(1.0, beta / max(delta, 1e-12))
    s = (1 - towards_pooled) * s + towards_pooled * pooled
    return (1 - rho) * s + rho * mu * np.eye(d) + 1e-3 * np.eye(d)


def fit(x: np.ndarray, y: np.ndarray, towards_pooled: float = 0.1, rates: np.ndarray | None = None) -> Discriminant:
    """Fit on vectors ``x`` and labels ``y``; a class without rows has the pooled Gaussian."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - centre) / scale, -12, 12)
    pooled = np.cov(z.T, bias=True) + 1e-3 * np.eye(z.shape[1])
    means, factors, half = [], [], []
    for c in (0, 1):
        own = z[y == c] if (y == c).any() else z
        means.append(own.mean(axis=0))
        low = np.linalg.cholesky(shrunk(own - means[-1], pooled, towards_pooled))
        factors.append(np.linalg.inv(low))
        half.append(np.log(np.diag(low)).sum())
    rates = np.zeros(len(SHARES)) if rates is None else rates
    raw = Discriminant(rates, centre, scale, np.array(means), np.array(factors), np.array(half), np.zeros(2))
    w = fit_logistic(_squeezed(raw.log_ratio(x)), y)
    return Discriminant(rates, centre, scale, raw.means, raw.factors, raw.half_logdet, w)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Discriminant:
    prepare(docs.sparkSession)
    sample = add_columns(labelled(docs, labels, "quality", rows), lambda texts: {"stats": [statistics(t) for t in texts]}, "stats array<double>")
    got = sample.select("doc_id", "label", "stats").toPandas().sort_values("doc_id")
    raw, y = np.array(got.stats.tolist(), float).reshape(len(got), len(statistics(None))), got.label.to_numpy(int)
    if not len(raw):
        raw, y = np.array([statistics(None)]), np.ones(1, int)
    rates = rates_of(raw[y == 1] if (y == 1).any() else raw)
    return fit(transformed(raw, rates), y, rates=rates)


def score(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 at ``threshold`` or above)."""

    def make(texts: list) -> dict:
        s = model.score(np.array([statistics(t) for t in texts])) if texts else np.empty(0)
        return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

    return add_columns(docs, make, "score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those rejected; all columns keep their values, whatever their names."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(np.array([statistics(t) for t in batch.column("text").to_pylist()]))
                yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
