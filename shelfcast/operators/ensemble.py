"""Weighted ensembles of quantile models, chosen by what each forecasts of days it has not seen.

Days are cut into contiguous folds. Every member is fitted without each fold and to
all days, side by side in one fit, and forecasts the fold left out. A greedy
selection with replacement then adds, round by round, the member whose addition
lowers the mean pinball loss most; the weights of the best round stay. Round one
is the best single member, so an ensemble is never worse than it out of fold.

Layout for scale: out-of-fold forecasts are written once, and each round is one
aggregation of them in the JVM that gives the driver a row a lead. Linear members are
fitted from sums of products (a small matrix a lead), added up by Spark.

Defined results: ties go to the member named first. A lead whose rows have fewer days than
folds is an error, as are no members; no rows give no models. Rows without a target are left out. Missing features are -1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import QUANTILES, pinball
from ..sources.shared import discard, importable, written
from .boosting import fit_models
from .learner import BoostConfig, Boosted

C = F.col
FOLDS, ROUNDS = 3, 10


@dataclass(frozen=True)
class LinearConfig:
    """Least squares of signed logarithms; ``ridge`` is a share of each feature's variance."""

    ridge: float = 1e-3
    log_sales: bool = True


@dataclass
class Linear:
    """One quantile of a linear model: ``start`` holds at the mean of the features."""

    quantile: float
    start: float
    mean: np.ndarray
    slope: np.ndarray
    n_rows: int = 0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + (_signed_log(x) - self.mean) @ self.slope

    def explain(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        return self.start, (_signed_log(x) - self.mean) * self.slope


@dataclass
class Blend:
    """Members of one quantile with their weights, which add up to 1."""

    quantile: float
    names: list[str]
    weights: list[float]
    models: list[Boosted | Linear]
    #: Mean losses out of fold: of every member by name, and of the blend.
    member_losses: dict[str, float] = field(default_factory=dict)
    loss: float = float("nan")

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum(w * m.predict(x) for w, m in zip(self.weights, self.models, strict=True))

    def explain(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Contributions are linear in the model, so those of a blend are blended."""
        told = [m.explain(x) for m in self.models]
        return sum(w * base for w, (base, _) in zip(self.weights, told, strict=True)), sum(w * shap for w, (_, shap) in zip(self.weights, told, strict=True))


Members = dict[str, BoostConfig | LinearConfig]


def default_members(config: BoostConfig = BoostConfig()) -> Members:
    """The booster asked for, one of few small trees, and a linear model."""
    shallow = replace(config, rounds=max(1, config.rounds // 3), learning_rate=min(1.0, 2 * config.learning_rate), leaves=4, depth=2)
    return {"boosted": config, "shallow": shallow, "linear": LinearConfig(log_sales=config.log_sales)}


def _signed_log(x: np.ndarray) -> np.ndarray:
    x = np.nan_to_num(np.asarray(x, float), nan=-1.0)
    return np.sign(x) * np.log1p(np.abs(x))


def in_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Adds _fold: contiguous spans of each lead's days, as many as ``folds``."""
    if folds < 2:
        raise ValueError("folds are 2 at least")
    span = rows.groupBy("lead").agg(F.min("date").alias("_first"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("_days"))
    # one row a lead
    of = F.floor(F.datediff("date", "_first") * folds / C("_days")).cast("int")
    return rows.join(F.broadcast(span), "lead").withColumn("_fold", of).drop("_first", "_days")


def fit_linear(rows: DataFrame, columns: list[str], config: LinearConfig = LinearConfig(), categorical: list[str] = ()) -> dict[int, list[Linear]]:
    """Linear models by lead of rows (lead, sales_count, columns).

    Categorical features have no slope. The quantiles of a lead share slopes and differ by
    the quantiles of what is left of the targets (ranks exact to 1 in 10,000).
    """
    importable(rows.sparkSession)
    width = len(columns)
    used = [k for k, c in enumerate(columns) if c not in categorical]
    flat = rows.filter("sales_count IS NOT NULL").select(C("lead").cast("int").alias("lead"), C("sales_count").cast("double").alias("_y"), *[C(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)])

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x = np.column_stack([batch.column(f"_x{k}").to_numpy(zero_copy_only=False) for k in range(width)]) if width else np.empty((batch.num_rows, 0))
        y = batch.column("_y").to_numpy(zero_copy_only=False)
        y = np.log1p(y) if config.log_sales else y
        leads = batch.column("lead").to_numpy()
        for lead in np.unique(leads).tolist():
            at = leads == lead
            yield lead, _signed_log(x[at]), y[at]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lead, x, y in parts(batch):
                z = np.column_stack([np.ones(len(y)), x, y])
                sums[lead] = sums.get(lead, 0) + z.T @ z
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], ["lead", "s"])

    told = flat.mapInArrow(products, "lead int, s array<double>").select("lead", F.posexplode("s").alias("at", "v")).groupBy("lead", "at").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in told.collect():
        found.setdefault(r.lead, np.zeros((width + 2) ** 2))[r["at"]] = r.v
    lines = {}
    for lead, s in found.items():
        s = s.reshape(width + 2, width + 2)
        n = s[0, 0]
        mean = s[0, 1:] / n
        cov = s[1:, 1:] / n - np.outer(mean, mean)
        live = [k for k in used if cov[k, k] > 1e-12]
        slope = np.zeros(width)
        if live:
            own = cov[np.ix_(live, live)]
            slope[live] = np.linalg.solve(own + config.ridge * np.diag(np.diag(own)), cov[live, -1])
        lines[lead] = (int(n), mean[-1], mean[:-1], slope)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lead, x, y in parts(batch):
                _, middle, mean, slope = lines[lead]
                yield pa.record_batch([pa.array(np.full(len(y), lead, np.int32)), pa.array(y - middle - (x - mean) @ slope)], ["lead", "r"])

    left = flat.mapInArrow(residuals, "lead int, r double").groupBy("lead").agg(F.percentile_approx("r", list(QUANTILES), 10_000).alias("q")).collect()
    out = {}
    for r in left:
        n, middle, mean, slope = lines[r.lead]
        out[r.lead] = [Linear(q, middle + r.q[i], mean, slope, n) for i, q in enumerate(QUANTILES)]
    return out


def selected(made: DataFrame, members: int, rounds: int = ROUNDS) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Weights [quantile, member], member losses [quantile, member] and blend losses by lead.

    ``made`` has lead, y and m<member>_<quantile>, all on the scale of the models.
    """
    quantiles = len(QUANTILES)
    spark = made.sparkSession
    leads = sorted(r.lead for r in made.select("lead").distinct().collect())
    counts = {lead: np.zeros((quantiles, members)) for lead in leads}
    best = {lead: (np.zeros((quantiles, members)), np.full(quantiles, np.inf)) for lead in leads}
    alone: dict[int, np.ndarray] = {}
    for t in range(rounds):
        told = spark.createDataFrame([(lead, c.ravel().tolist()) for lead, c in counts.items()], "lead int, _c array<double>")
        each = []
        for i, q in enumerate(QUANTILES):
            so_far = sum((C("_c")[i * members + j] * C(f"m{j}_{i}") for j in range(members)), F.lit(0.0))
            each += [F.avg(pinball(C("y"), (so_far + C(f"m{j}_{i}")) / (t + 1), q)).alias(f"l{i}_{j}") for j in range(members)]
        for r in made.join(F.broadcast(told), "lead").groupBy("lead").agg(*each).collect():
            losses = np.array([[r[f"l{i}_{j}"] for j in range(members)] for i in range(quantiles)])
            alone.setdefault(r.lead, losses)
            for i in range(quantiles):
                # sums of doubles differ in their last digits with the order of rows
                j = int(np.flatnonzero(losses[i] <= losses[i].min() * (1 + 1e-12))[0])
                counts[r.lead][i, j] += 1
                weights, lowest = best[r.lead]
                if losses[i, j] < lowest[i] * (1 - 1e-12) or np.isinf(lowest[i]):
                    weights[i], lowest[i] = counts[r.lead][i] / (t + 1), losses[i, j]
    return {lead: (weights, alone[lead], lowest) for lead, (weights, lowest) in best.items()}


def out_of_fold(rows: DataFrame, columns: list[str], fitted: list[dict[int, list]], folds: int, log_sales: bool) -> DataFrame:
    """lead, y and m<member>_<quantile>: each row forecast by the models of its lead that left its fold out."""
    names = [f"m{j}_{i}" for j in range(len(fitted)) for i in range(len(QUANTILES))]
    spec = "lead int, y double, " + ", ".join(f"{n} double" for n in names)
    flat = rows.select(C("lead").cast("int").alias("lead"), "_fold", C("sales_count").cast("double").alias("_y"), *[F.nanvl(F.coalesce(C(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)).alias(f"_x{k}") for k, c in enumerate(columns)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part[[f"_x{k}" for k in range(len(columns))]].to_numpy(float)
            made = np.empty((len(part), len(names)))
            for (lead, fold), at in part.groupby(["lead", "_fold"]).indices.items():
                of = [m for by in fitted for m in by[lead * (folds + 1) + fold]]
                made[at] = np.column_stack([m.predict(x[at]) for m in of])
            y = part["_y"].to_numpy(float)
            out = pd.DataFrame(made, columns=names)
            out.insert(0, "lead", part["lead"].to_numpy())
            out.insert(1, "y", np.log1p(y) if log_sales else y)
            yield out

    return flat.mapInPandas(run, spec)


def train_ensemble(rows: DataFrame, columns: list[str], keys: list[str], members: Members | None = None, categorical: list[str] = (), folds: int = FOLDS, rounds: int = ROUNDS) -> dict[int, list[Blend]]:
    """Blends by lead, in the order of the quantiles, of rows (lead, keys with date, sales_count, columns).

    A blend stands wherever a list of fitted models does: recursion, direct leads, explanations.
    """
    members = default_members() if members is None else members
    if not members or rounds < 1:
        raise ValueError("an ensemble has one member and one round at least")
    if len(logs := {c.log_sales for c in members.values()}) > 1:
        raise ValueError("members disagree on the scale of sales")
    spark = rows.sparkSession
    importable(spark)
    if "lead" not in rows.columns:
        rows = rows.withColumn("lead", F.lit(0))
    rows = written(in_folds(rows.filter("sales_count IS NOT NULL"), folds).select("lead", "_fold", "sales_count", *keys, *[c for c in columns if c not in keys]), "ensemble")
    held = rows.groupBy("lead").agg(F.count_distinct("_fold").alias("n")).agg(F.count("*").alias("leads"), F.count_if(C("n") < folds).alias("few")).first()
    if held.few:
        raise ValueError(f"{held.few} leads have rows in fewer than {folds} folds")
    if not held.leads:
        return {}
    # fold f is left out of models f; models of number ``folds`` know all rows
    spread = rows.withColumn("_for", F.explode(F.sequence(F.lit(0), F.lit(folds)))).filter("_for != _fold")
    spread = spread.withColumn("lead", (C("lead") * (folds + 1) + C("_for")).cast("int")).drop("_for", "_fold")
    fitted = [fit_linear(spread, columns, c, categorical) if isinstance(c, LinearConfig) else fit_models(spread, columns, keys, c, categorical) for c in members.values()]
    made = written(out_of_fold(rows, columns, fitted, folds, logs.pop()), "out_of_fold")
    names, out = list(members), {}
    for lead, (weights, alone, lowest) in selected(made, len(members), rounds).items():
        out[lead] = []
        for i, q in enumerate(QUANTILES):
            used = np.flatnonzero(weights[i]).tolist()
            models = [fitted[j][lead * (folds + 1) + folds][i] for j in used]
            out[lead].append(Blend(q, [names[j] for j in used], [float(weights[i, j]) for j in used], models, dict(zip(names, alone[i].tolist(), strict=True)), float(lowest[i])))
    discard(made)
    discard(rows)
    return out


WEIGHTS = "lead int, quantile double, member string, weight double, member_loss double, ensemble_loss double"


def weight_table(spark, blends: dict[int, list[Blend]]) -> DataFrame:
    """One row a lead, quantile and member, those of weight 0 too."""
    rows = [(lead, b.quantile, n, dict(zip(b.names, b.weights, strict=True)).get(n, 0.0), loss, b.loss) for lead, by in blends.items() for b in by for n, loss in b.member_losses.items()]
    return spark.createDataFrame(rows, WEIGHTS)
