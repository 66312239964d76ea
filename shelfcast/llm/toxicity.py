"""Toxic spans by a linear-chain conditional random field, and document scores.

Words carry identity and prefix features. A feature enters the lexicon if it is
far more frequent in documents labelled toxic than chance allows; a token is
labelled 1 where a lexicon word stands in a toxic document and 0 elsewhere. A
lexicon word also carries features of its context: a lexicon word just before and
just behind it. A two-state chain (clean, toxic) is fitted to all tokens of the
labelled sample by maximum likelihood (L-BFGS). Its forward-backward marginals
give spans with character offsets, and a logistic function of them a document's
score.

Tokens without a lexicon feature are alike to the chain. A run of g of them is the
g-th power of one 2x2 matrix, for messages as well as for gradients (by its
eigenvectors), which is exact: a document costs one look-up a word plus work for
its lexicon words, in training and in scoring.

Layout for scale
  The sample is bounded; its lexicon words are written once to the shared folder
  and every gradient is summed up where they lie, so the driver holds the weights
  and one number a sample document. Scoring is one pass over whole texts without
  a shuffle.

Defined results
  Null and empty texts have no tokens and get the score of no evidence; an empty
  table gives no rows. Columns named like added ones are replaced. Without
  labelled rows, or without a feature that tells toxic documents apart, scores are
  the share of toxic ones. Rows that repeat an id are scored each; in the sample
  an id counts once, by its smallest text, and rows with a null id or label not at
  all. Ties in the lexicon can't arise, as all features above the bars enter it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, forget, prepare, stored
from .learn import SAMPLE, add_columns, fit_logistic, labelled, sigmoid

THRESHOLD = 0.3
#: A lexicon feature: this many toxic documents and standard deviations at least.
LEAST, DEVIATIONS = 5, 6.0
#: Lexicon words, padding counted, of the documents whose gradient is worked out together.
CELLS = 200_000
#: Steps of the fit at most, and its ridge.
ROUNDS, L2 = 40, 1.0
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words of a text in lower case: split first, so each has its place in the text."""
    return [w.lower() for w in _WORD.findall(text or "")]


def features(word: str) -> list[str]:
    """Identity and prefixes of 4 to 6 letters of a lower-case word."""
    return [f"={word}", *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = {0: Counter(), 1: Counter()}

    def rows() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.record_batch([pa.array(names, pa.string()), pa.array([counts[1][x] for x in names], pa.int64()), pa.array([counts[0][x] for x in names], pa.int64())], ["feature", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(words_of(text)) for f in features(w)}
            counts[int(label > 0)].update(found)
        if len(counts[0]) + len(counts[1]) > CACHE_WORDS:
            yield rows()
    yield rows()


def lexicon(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """Features bound to toxic documents."""
    if not toxic or not clean:
        return []
    n = F.col("toxic") + F.col("clean")
    p = toxic / (toxic + clean)
    counts = sample.select("text", "label").mapInArrow(_counted, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    z = (F.col("toxic") - n * p) / F.sqrt(n * p * (1 - p))
    strong = counts.filter(F.col("toxic") >= LEAST).withColumn("z", z).filter((F.col("z") >= DEVIATIONS) & (F.col("toxic") >= 0.5 * n))
    return sorted(r.feature for r in strong.select("feature").collect())


class Emissions(dict):
    """word as it stands -> what it adds to the log-potential of the toxic state; 0: neutral.

    Lower case is that of the word alone, as in :func:`words_of`: scores and spans then
    come from the same words, also where a letter has two in lower case.
    """

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = [self.weights[f] for f in features(word.lower()) if f in self.weights]
        value = (sum(got) or 1e-9) if got else 0.0
        if len(word) <= 64:
            self[word] = value
        return value


@dataclass(frozen=True)
class Chain:
    """Two-state chain: log-potentials of transitions, toxic bias, start; feature weights."""

    transitions: np.ndarray
    bias: float
    start: float
    weights: dict[str, float]
    calibration: np.ndarray
    #: What a lexicon word just before, and just behind, adds to a lexicon word.
    around: tuple[float, float] = (0.0, 0.0)

    def in_context(self, places: np.ndarray, emissions: np.ndarray) -> np.ndarray:
        """Emissions of lexicon words at ``places`` with what their neighbours add."""
        beside = np.diff(places) == 1
        out = emissions.astype(np.float64)
        out[1:] += self.around[0] * beside
        out[:-1] += self.around[1] * beside
        return out

    def step(self, emission: float = 0.0) -> np.ndarray:
        return np.exp(self.transitions) * np.array([1.0, np.exp(self.bias + emission)])

    def all_marginals(self, emissions: np.ndarray) -> np.ndarray:
        """P(toxic) of each token, by forward-backward over every token.

        Messages are kept as the ratio of the toxic to the clean state.
        """
        n = len(emissions)
        (a, b), (c, d) = np.exp(self.transitions).tolist()
        e = np.exp(np.clip(self.bias + emissions, -60, 60)).tolist()
        p, r = [0.0] * n, 0.0
        for t in range(n):
            r = e[t] * ((b + d * r) / (a + c * r) if t else float(np.exp(self.start)))
            p[t] = r
        back = 1.0
        for t in range(n - 1, -1, -1):
            x = p[t] * back
            p[t] = x / (1 + x)
            back = (c + d * e[t] * back) / (a + b * e[t] * back)
        return np.array(p)

    def powers(self):
        """g -> the entries of (neutral step)**g up to a factor, by its eigenvectors."""
        values, vectors = np.linalg.eig(self.step())
        top = int(np.argmax(values.real))
        inverse, ratio = np.linalg.inv(vectors), values / values[top]
        kept: dict[int, list[float]] = {}

        def power(g: int) -> list[float]:
            if g not in kept:
                if len(kept) > CACHE_WORDS:
                    kept.clear()
                kept[g] = ((vectors * ratio**g) @ inverse).real.ravel().tolist()
            return kept[g]

        return power

    def marginals_at(self, places: list[int], emissions: list[float], n: int, power=None) -> np.ndarray:
        """P(toxic) of the tokens at ``places``; the other n - len(places) are neutral."""
        if not len(places):
            return np.empty(0)
        power = power or self.powers()
        (a, b), (c, d) = np.exp(self.transitions).tolist()
        e = np.exp(np.clip(self.bias + np.asarray(emissions), -60, 60)).tolist()
        start, neutral = float(np.exp(self.start)), float(np.exp(self.bias))
        p, r, at = [], 0.0, -1
        for t, x in zip(places, e, strict=True):
            if t == 0:
                r = start * x
            else:
                if at < 0:  # neutral tokens before the first place
                    r, at = start * neutral, 0
                h = power(t - at - 1)
                r = (h[1] + h[3] * r) / (h[0] + h[2] * r)
                r = x * (b + d * r) / (a + c * r)
            p.append(r)
            at = t
        h = power(n - 1 - at)
        back = (h[2] + h[3]) / (h[0] + h[1])
        for k in range(len(places) - 1, -1, -1):
            x = p[k] * back
            p[k] = x / (1 + x)
            if k:
                back = (c + d * e[k] * back) / (a + b * e[k] * back)
                h = power(places[k] - places[k - 1] - 1)
                back = (h[2] + h[3] * back) / (h[0] + h[1] * back)
        return np.array(p)

    def evidence(self, p: np.ndarray) -> list[float]:
        """What a document's score is made of: the highest marginal and all together."""
        q = np.clip(p, 0, 1 - 1e-9)
        return [float(q.max()), float(np.log1p(-np.log1p(-q).sum()))] if len(q) else [0.0, 0.0]

    def score(self, p: np.ndarray) -> float:
        return float(sigmoid(np.array(self.evidence(p)) @ self.calibration[:-1] + self.calibration[-1]))


def _events(names: set[str]):
    """Per document: its label, its number of tokens, and its lexicon words with places."""
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Emissions(dict.fromkeys(names, 1.0))
        for batch in batches:
            rows = []
            for text, label in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                words = words_of(text)
                places = [t for t, e in enumerate(map(known.__getitem__, words)) if e]
                rows.append((int(label > 0), len(words), places, [words[t] for t in places]))
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["label", "n", "places", "words"])

    return run


#: Weights behind those of features: before, behind, four transitions (row by row), bias, start.
SHARED = 8


class Gradient:
    """Log-likelihood of documents under the chain, with its gradient.

    ``documents`` are (label, tokens, places and words of lexicon words). The sums
    run over all tokens; those between lexicon words through powers of a matrix.
    """

    def __init__(self, theta: np.ndarray, column: dict[str, int]):
        self.theta, self.column = theta, column
        self.before, self.behind = theta[-SHARED], theta[-SHARED + 1]
        self.log_step = theta[-6:-2].reshape(2, 2)
        self.steps = np.exp(self.log_step)
        self.bias, self.start = theta[-2], theta[-1]
        self.neutral = self.steps * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(self.neutral)
        order = np.argsort(-values.real)
        self.values, self.vectors = values.real[order], vectors.real[:, order]
        self.inverse = np.linalg.inv(self.vectors)
        # derivatives of the neutral step by its four transitions and the bias, in the eigenbasis
        d = np.zeros((5, 2, 2))
        for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            d[k, a, b] = self.neutral[a, b]
        d[4, :, 1] = self.neutral[:, 1]
        self.derivative = self.inverse @ d @ self.vectors
        self.value, self.sums, self.tokens = 0.0, np.zeros_like(theta), 0

    def powers(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each neutral step to the power g: itself and its five derivatives, over a scale; log scale."""
        g = np.maximum(g, 0).astype(float)
        ratio = self.values[1] / self.values[0]
        low = np.where(g > 0, ratio**g, 1.0)
        power = (self.vectors[None] * np.stack([np.ones_like(g), low], axis=1)[:, None, :]) @ self.inverse
        f = np.empty((len(g), 2, 2))
        f[:, 0, 0] = g
        f[:, 1, 1] = g * np.where(g > 0, ratio ** np.maximum(g - 1, 0), 0)
        f[:, 0, 1] = f[:, 1, 0] = (1 - low) / (1 - ratio)
        d = self.vectors @ (f[None] * self.derivative[:, None]) @ self.inverse / self.values[0]
        return power, d, g * np.log(self.values[0])

    def add(self, documents: list[tuple]) -> None:
        """Documents of about as many lexicon words each."""
        s, m = len(documents), max(len(p) for _, _, p, _ in documents)
        n = np.array([x[1] for x in documents])
        there = np.zeros((s, m), bool)
        place = np.zeros((s, m), np.int64)
        word = np.zeros((s, m), np.int64)
        number: dict[str, int] = {}
        for i, (_, _, p, w) in enumerate(documents):
            there[i, : len(p)], place[i, : len(p)] = True, p
            word[i, : len(p)] = [number.setdefault(x, len(number)) for x in w]
        label = np.array([x[0] for x in documents])[:, None] * there
        of = [[self.column[f] for f in features(w) if f in self.column] for w in number]
        weight = np.array([self.theta[f].sum() for f in of] or [0.0])
        beside = np.zeros((s, m), bool)
        beside[:, 1:] = there[:, 1:] & (np.diff(place, axis=1) == 1)
        next_to = np.zeros((s, m), bool)
        next_to[:, :-1] = beside[:, 1:]
        x = weight[word] + self.before * beside + self.behind * next_to + self.bias
        e = np.exp(np.clip(x, -60, 60))
        # the first token is a message of its own; segment j lies between lexicon words j - 1 and j
        at_zero = there[:, 0] & (place[:, 0] == 0) if m else np.zeros(s, bool)
        first = np.stack([np.ones(s), np.exp(self.start + np.where(at_zero, x[:, 0] if m else 0.0, self.bias))], axis=1)
        some = n > 0
        scale = np.zeros(s)
        messages, gaps, kept = [first], [], []
        now = first
        for j in range(m):
            gap = place[:, j] - 1 if j == 0 else place[:, j] - place[:, j - 1] - 1
            power, d, log = self.powers(gap)
            live = there[:, j] & ~at_zero if j == 0 else there[:, j]
            before = (now[:, None, :] @ power)[:, 0]
            new = before @ self.steps
            new[:, 1] *= e[:, j]
            total = new.sum(axis=1)
            scale += np.where(live, log + np.log(total), 0.0)
            new = np.where(live[:, None], new / total[:, None], now)
            gaps.append((d, power, before, live))
            kept.append(now)
            now = new
            messages.append(now)
        last = np.where(there.any(axis=1), place.max(axis=1) if m else 0, 0)
        power, d, log = self.powers(n - 1 - last)
        ends = power.sum(axis=2)
        total = (now * ends).sum(axis=1)
        logz = scale + log + np.log(total)
        expected = np.zeros((5, s))
        expected += np.einsum("sa,ksab->ks", now, d) / total
        p = np.zeros((s, m))
        steps = np.zeros((4, s))
        back = ends / ends.sum(axis=1, keepdims=True)
        for j in range(m - 1, -1, -1):
            d, power, before, live = gaps[j]
            mine = messages[j + 1] * back
            p[:, j] = np.where(there[:, j], mine[:, 1] / mine.sum(axis=1), 0.0)
            right = back.copy()
            right[:, 1] *= e[:, j]
            into = right @ self.steps.T
            total = (before * into).sum(axis=1)
            move = before[:, :, None] * self.steps[None] * right[:, None, :] / total[:, None, None]
            steps += np.where(live, move.reshape(s, 4).T, 0.0)
            expected += np.where(live, np.einsum("sa,ksab,sb->ks", kept[j], d, into) / total, 0.0)
            left = (power @ into[:, :, None])[:, :, 0]
            back = np.where(live[:, None], left / left.sum(axis=1, keepdims=True), back)
        one = first * back
        toxic_first = one[:, 1] / one.sum(axis=1)
        # what the labels have of each weight
        pairs = np.zeros((4, s))
        pairs[3] = (label[:, 1:] * label[:, :-1] * beside[:, 1:]).sum(axis=1) if m else 0
        starts = np.where(at_zero, label[:, 0] if m else 0, 0)
        ended = (label * ((place == n[:, None] - 1) & there)).sum(axis=1)
        pairs[1] = label.sum(axis=1) - starts - pairs[3]
        pairs[2] = label.sum(axis=1) - ended - pairs[3]
        pairs[0] = np.maximum(n - 1, 0) - pairs[1:].sum(axis=0)
        own = (label * x).sum(axis=1) + self.start * starts + (pairs * self.log_step.reshape(4, 1)).sum(axis=0)
        self.value += float(np.where(some, own - logz, 0.0).sum())
        self.tokens += int(n.sum())
        left = (label - p) * there
        by_word = np.bincount(word.ravel(), left.ravel(), max(1, len(number)))
        for k, f in enumerate(of):
            self.sums[f] += by_word[k]
        self.sums[-SHARED] += (left * beside).sum()
        self.sums[-SHARED + 1] += (left * next_to).sum()
        self.sums[-6:-2] += np.where(some, pairs - steps - expected[:4], 0.0).sum(axis=1)
        # the bias counts at lexicon words, at the first token and in the powers
        neutral_first = np.where(at_zero, 0.0, toxic_first)
        self.sums[-2] += np.where(some, left.sum(axis=1) - expected[4] - neutral_first, 0.0).sum()
        self.sums[-1] += np.where(some, starts - toxic_first, 0.0).sum()


def _gradients(theta: np.ndarray, column: dict[str, int]):
    """One row a task: log-likelihood, tokens, gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Gradient(theta, column)
        held: dict[int, list] = {}
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                width = len(x[2]).bit_length()
                held.setdefault(width, []).append(x)
                if len(held[width]) << width >= CELLS:
                    g.add(held.pop(width))
        for some in held.values():
            g.add(some)
        yield pa.record_batch([pa.array([[g.value, float(g.tokens), *g.sums]], pa.list_(pa.float64()))], ["sums"])

    return run


def climb(f, theta: np.ndarray, rounds: int = ROUNDS, memory: int = 8) -> np.ndarray:
    """Largest value of ``f``, which tells value and gradient, by L-BFGS."""
    value, grad = f(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = grad.copy(), []
        for s, y in reversed(steps):
            a = s @ way / (s @ y)
            kept.append(a)
            way -= a * y
        if steps:
            s, y = steps[-1]
            way *= s @ y / (y @ y)
        else:
            way /= max(1.0, np.abs(grad).sum())
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way += s * (a - y @ way / (s @ y))
        size = 1.0
        while True:
            there = theta + size * way
            new, new_grad = f(there)
            if new >= value + 1e-4 * size * (grad @ way) or size < 1e-4:
                break
            size /= 4
        s, y = there - theta, grad - new_grad
        gain = new - value
        if gain <= 0:
            break
        theta, value, grad = there, new, new_grad
        if s @ y > 0:  # as of a concave function
            steps = [*steps, (s, y)][-memory:]
        if gain < 1e-7 * max(1.0, abs(value)):
            break
    return theta


def fit_chain(events: DataFrame, names: list[str]) -> Chain:
    """Maximum likelihood over all tokens of ``events``, gradients summed in the executors."""
    column = {f: k for k, f in enumerate(names)}

    def f(theta: np.ndarray) -> tuple[float, np.ndarray]:
        got = np.array([r.sums for r in events.mapInArrow(_gradients(theta, column), "sums array<double>").collect()]).sum(axis=0)
        size = max(1.0, got[1])
        return (got[0] - L2 / 2 * theta @ theta) / size, (got[2:] - L2 * theta) / size

    # from words of the lexicon being toxic and others not
    theta = np.zeros(len(names) + SHARED)
    theta[: len(names)], theta[-2] = 2.0, -4.0
    theta = climb(f, theta)
    return Chain(theta[-6:-2].reshape(2, 2), float(theta[-2]), float(theta[-1]), {w: float(theta[k]) for w, k in column.items()}, np.zeros(3), (float(theta[-SHARED]), float(theta[-SHARED + 1])))


def _evidence(model: Chain):
    """Of each document: its label and what its score is made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, power = Emissions(model.weights), model.powers()
        for batch in batches:
            rows = []
            for label, n, places, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e = model.in_context(np.array(places, np.int64), np.array([known[w] for w in words]))
                rows.append((float(label), *model.evidence(model.marginals_at(places, e, n, power))))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["label", "top", "all"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Chain:
    """Fit lexicon, chain and calibration on a bounded sample of labelled documents."""
    prepare(docs.sparkSession)
    sample = stored(labelled(docs, labels, "toxic", rows), "toxic-sample")
    told = {r.t: r.n for r in sample.groupBy((F.col("label") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    names = lexicon(sample, told.get(1, 0), told.get(0, 0))
    if not names:
        base = told.get(1, 0) / max(1, sum(told.values()))
        forget(sample)
        return Chain(np.zeros((2, 2)), -20.0, 0.0, {}, np.array([0.0, 0.0, np.log((base + 1e-6) / (1 - base + 1e-6))]))
    events = stored(sample.select("text", "label").mapInArrow(_events(set(names)), "label int, n long, places array<long>, words array<string>"), "toxic-events")
    raw = fit_chain(events, names)
    x = np.array(sorted(map(tuple, events.mapInArrow(_evidence(raw), "label double, top double, all double").collect())))
    for df in (sample, events):
        forget(df)
    return replace(raw, calibration=fit_logistic(x[:, 1:], x[:, 0]))


def tag(text: str | None, model: Chain, known: Emissions, threshold: float = 0.5) -> list[dict]:
    """Maximal runs of tokens whose marginal reaches ``threshold``, with offsets."""
    found = list(_WORD.finditer(text or ""))
    e = np.array([known[m[0]] for m in found])
    at = np.flatnonzero(e)
    if len(at):
        e[at] = model.in_context(at, e[at])
    p = model.all_marginals(e)
    out: list[dict] = []
    for k, (m, q) in enumerate(zip(found, p.tolist(), strict=True)):
        if q < threshold:
            continue
        if out and out[-1]["token"] == k - 1:
            out[-1].update(token=k, stop=m.end(), marginal=max(out[-1]["marginal"], q))
        else:
            out.append({"token": k, "start": m.start(), "stop": m.end(), "marginal": q})
    return [{k: v for k, v in x.items() if k != "token"} for x in out]


def score(docs: DataFrame, model: Chain, threshold: float = THRESHOLD, spans: bool = True) -> DataFrame:
    """``docs`` with score, predicted, n_spans and (``spans``) toxic spans with offsets."""

    held: dict = {}  # filled in the worker, once a task

    def make(texts: list) -> dict:
        if not held:
            held.update(words=Emissions(model.weights), power=model.powers())
        known, power = held["words"], held["power"]
        out: dict[str, list] = {"score": [], "predicted": [], "spans": []}
        for text in texts:
            words = _WORD.findall(text or "")
            e = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            places = np.flatnonzero(e)
            p = model.marginals_at(places.tolist(), model.in_context(places, e[places]), len(words), power)
            s = model.score(p)
            out["score"].append(s)
            out["predicted"].append(int(s >= threshold))
            if spans:
                out["spans"].append(tag(text, model, known) if len(p) and p.max() >= 0.5 else [])
        return out

    return add_columns(docs, make, "score double, predicted int" + ", spans array<struct<start:long,stop:long,marginal:double>>" * spans)
