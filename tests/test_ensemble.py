"""Ensembles: folds, linear members, greedy selection, recursion and the command line."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.metrics import NAMES, QUANTILES
from shelfcast.operators import ensemble, forecaster, shap
from shelfcast.operators.ensemble import Blend, LinearConfig
from shelfcast.operators.learner import BoostConfig
from shelfcast.plans import forecasting, stages

D = date(2026, 1, 1)
KEYS = ["date", "store_id", "product_id"]
SMALL = BoostConfig(rounds=3, depth=2, leaves=4, min_leaf=2)
SCHEMA = "lead int, date date, store_id int, product_id string, sales_count double, a double, b double, c double"


def _rows(days=60, leads=(0, 3), seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for lead in leads:
        for d in range(days):
            for s in (1, 2):
                a, b = rng.normal(), float(rng.integers(0, 4))
                out.append((lead, D + timedelta(d), s, "p", float(max(0.0, 4 + 2 * a - b + lead + rng.normal())), a, b, 7.0))
    return out


def _pinball(y, f, q):
    return np.mean(np.maximum(q * (y - f), (q - 1) * (y - f)))


def _greedy(y, made, q, rounds):
    """made [member, row]: best weights of a selection with replacement, by hand."""
    counts, best, low = np.zeros(len(made)), None, np.inf
    for t in range(rounds):
        losses = [_pinball(y, (counts @ made + m) / (t + 1), q) for m in made]
        j = int(np.argmin(losses))
        counts[j] += 1
        if losses[j] < low - 1e-12:
            best, low = counts / (t + 1), losses[j]
    return best, low


def test_selection_equals_brute_force_and_is_never_worse_than_its_best_member(spark):
    rng = np.random.default_rng(1)
    rows, held = [], {}
    for lead in (0, 7):
        y = rng.normal(size=300)
        made = np.stack([[y + rng.normal(scale=1 + j, size=300) + off for _ in QUANTILES] for j, off in enumerate((0.4, -0.5, 0.0))])
        held[lead] = y, made
        rows += [(lead, float(y[r]), *made[:, :, r].ravel().tolist()) for r in range(300)]
    names = ", ".join(f"m{j}_{i} double" for j in range(3) for i in range(4))
    got = ensemble.selected(spark.createDataFrame(rows, f"lead int, y double, {names}").repartition(5), 3, 8)
    assert set(got) == {0, 7}
    mixed = 0
    for lead, (weights, alone, lowest) in got.items():
        y, made = held[lead]
        for i, q in enumerate(QUANTILES):
            want, low = _greedy(y, made[:, i], q, 8)
            assert weights[i] == pytest.approx(want) and weights[i].sum() == pytest.approx(1) and lowest[i] == pytest.approx(low)
            assert alone[i] == pytest.approx([_pinball(y, m, q) for m in made[:, i]]) and lowest[i] <= alone[i].min()
            mixed += (weights[i] > 0).sum() > 1
    assert mixed > 4  # blends, not just the best member


def test_equal_members_tie_and_the_first_is_taken(spark):
    names = ", ".join(f"m{j}_{i} double" for j in range(2) for i in range(4))
    rows = [(0, float(k), *[float(k % 3)] * 8) for k in range(50)]
    weights, alone, lowest = ensemble.selected(spark.createDataFrame(rows, f"lead int, y double, {names}"), 2, 4)[0]
    assert (weights == [[1.0, 0.0]] * 4).all() and lowest == pytest.approx(alone[:, 0])


def test_linear_members_equal_least_squares(spark):
    rows = _rows(leads=(0, 3))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = ensemble.fit_linear(df, ["a", "b", "c"], LinearConfig(ridge=0.0))
    for lead in (0, 3):
        x = np.array([r[5:] for r in rows if r[0] == lead])
        y = np.log1p([r[4] for r in rows if r[0] == lead])
        t = np.sign(x) * np.log1p(np.abs(x))
        slope = np.linalg.lstsq(np.column_stack([np.ones(len(y)), t[:, :2]]), y, rcond=None)[0]
        m = got[lead][1]
        assert m.slope == pytest.approx([*slope[1:], 0.0], abs=1e-8) and m.n_rows == 120  # a constant has no slope
        left = np.sort(y - (np.column_stack([np.ones(len(y)), t[:, :2]]) @ slope))
        for q, m in zip(QUANTILES, got[lead], strict=True):
            r = m.start - (slope[0] + t[:, :2].mean(axis=0) @ slope[1:])
            assert np.mean(left <= r + 1e-9) == pytest.approx(q, abs=0.01)
            base, told = m.explain(x)
            assert base + told.sum(axis=1) == pytest.approx(m.predict(x))
    assert ensemble.fit_linear(df, ["a", "b"], categorical=["b"])[0][0].slope[1] == 0
    # a missing feature is -1, as for trees
    assert m.predict(np.array([[np.nan, 1.0, 7.0]])) == m.predict(np.array([[-1.0, 1.0, 7.0]]))


def test_folds_are_spans_of_days_of_each_lead(spark):
    rows = [(lead, D + timedelta(d)) for lead, n in ((0, 10), (1, 3)) for d in range(n)]
    got = ensemble.in_folds(spark.createDataFrame(rows, "lead int, date date"), 3).collect()
    assert [r._fold for r in sorted(got) if r.lead == 0] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert [r._fold for r in sorted(got) if r.lead == 1] == [0, 1, 2]


def test_no_fold_is_forecast_by_models_that_saw_it(spark, monkeypatch):
    kept = []
    real = ensemble.selected
    monkeypatch.setattr(ensemble, "selected", lambda made, *rest: kept.append(made.orderBy("lead", *[c for c in made.columns if c[0] == "m"]).toPandas()) or real(made, *rest))
    rows = _rows(leads=(0,))
    changed = [(*r[:4], r[4] * 9 + 3, *r[5:]) if r[1] >= D + timedelta(40) else r for r in rows]
    for part in (rows, changed):
        ensemble.train_ensemble(spark.createDataFrame(part, SCHEMA), ["a", "b"], KEYS, {"trees": SMALL, "line": LinearConfig()}, rounds=2)
    a, b = (k[[c for c in k.columns if c[0] == "m"]].round(9).apply(tuple, axis=1) for k in kept)
    # the last third's sales changed: its own forecasts stay, those of the others, fitted to it, change
    assert len(a) == 120 and len(set(a) & set(b)) == 40


def test_blends_forecast_and_explain_as_their_members_do(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    got = ensemble.train_ensemble(df, ["a", "b", "c"], KEYS, {"trees": SMALL, "line": LinearConfig()}, rounds=5)
    x = np.array([r[5:] for r in _rows()[:30]])
    assert set(got) == {0, 3}
    for by in got.values():
        assert [b.quantile for b in by] == list(QUANTILES)
        for b in by:
            assert sum(b.weights) == pytest.approx(1) and b.loss <= min(b.member_losses.values())
            assert b.predict(x) == pytest.approx(sum(w * m.predict(x) for w, m in zip(b.weights, b.models, strict=True)))
            base, told = b.explain(x)
            assert base + told.sum(axis=1) == pytest.approx(b.predict(x), abs=1e-9)
    told = ensemble.weight_table(spark, got).collect()
    assert len(told) == 2 * 4 * 2 and all(r.ensemble_loss <= r.member_loss for r in told)
    # the order and the layout of rows change nothing
    again = ensemble.train_ensemble(df.orderBy(F.rand(3)).repartition(9), ["a", "b", "c"], KEYS, {"trees": SMALL, "line": LinearConfig()}, rounds=5)
    assert all(p.predict(x) == pytest.approx(q.predict(x), abs=1e-9) for lead in got for p, q in zip(got[lead], again[lead], strict=True))


def test_defined_results_and_errors(spark):
    df = spark.createDataFrame(_rows(days=2), SCHEMA)
    with pytest.raises(ValueError, match="fewer than 3 folds"):
        ensemble.train_ensemble(df, ["a"], KEYS, {"line": LinearConfig()})
    with pytest.raises(ValueError, match="one member"):
        ensemble.train_ensemble(df, ["a"], KEYS, {})
    with pytest.raises(ValueError, match="2 at least"):
        ensemble.in_folds(df, 1)
    with pytest.raises(ValueError, match="scale"):
        ensemble.train_ensemble(df, ["a"], KEYS, {"x": LinearConfig(), "y": LinearConfig(log_sales=False)})
    assert ensemble.train_ensemble(df.limit(0), ["a"], KEYS, {"line": LinearConfig()}) == {}
    # rows without a target are left out, nulls among features are missing
    more = spark.createDataFrame([(0, D + timedelta(d), 1, "p", None if d % 2 else float(d), None, 1.0, 7.0) for d in range(12)], SCHEMA)
    got = ensemble.train_ensemble(more, ["a", "b"], KEYS, {"line": LinearConfig()})
    assert got[0][0].models[0].n_rows == 6


def _panel(spark, days=60, ahead=3):
    rows = [(f"{i}|{s}|{p}", D + timedelta(i), s, p, float((i * s + len(p)) % 9) if i < days - ahead else None, "train" if i < days - ahead else "test", i % 5 == 0) for i in range(days) for s in (1, 2) for p in ("a", "bb")]
    return spark.createDataFrame(rows, "id string, date date, store_id int, product_id string, sales_count double, dataset_split string, promotion boolean")


def test_recursion_and_explanations_take_blends(spark):
    p = _panel(spark)
    models = forecasting.fitted(p, ["promotion"], "recursive", 3, SMALL, "ensemble")
    assert all(isinstance(b, Blend) for b in models[0])
    made = forecaster.recursive_forecast(p, models, ["promotion"]).collect()
    assert len(made) == 12 and all(0 <= r.p25 <= r.p50 <= r.p75 <= r.p95 for r in made)
    told = forecasting.sidecar(p, models[0], ["promotion"], SMALL)
    worst = told.select(F.max(F.abs(F.col("base_value") + sum(F.col(c) for c in shap.contributions(told)) - F.col("raw_model")))).first()[0]
    assert told.count() == 48 and worst < 1e-9
    # one member alone is that member's own recursion
    alone = {0: [Blend(m.quantile, ["m"], [1.0], [m]) for m in (b.models[0] for b in models[0])]}
    plain = {0: [b.models[0] for b in models[0]]}
    assert forecaster.recursive_forecast(p, alone, ["promotion"]).sort(*KEYS).collect() == forecaster.recursive_forecast(p, plain, ["promotion"]).sort(*KEYS).collect()


@pytest.mark.parametrize("strategy", forecasting.STRATEGIES)
def test_rolling_evaluation_of_an_ensemble(spark, strategy):
    got = forecasting.rolling_evaluation(_panel(spark), ["promotion"], 1, 2, strategy, SMALL, model="ensemble")
    assert got["model"] == "ensemble" and got["windows"][0]["n_rows"] == 8
    assert got["mean_pinball"] == pytest.approx(sum(got[f"pinball_{n}"] for n in NAMES) / 4)


def test_the_training_stage_knows_the_ensemble(spark, tmp_path):
    table = _panel(spark).filter("sales_count is not null").withColumn("feature_day", F.dayofmonth("date").cast("double"))
    got = stages.train_and_evaluate(table, str(tmp_path / "r.json"), "ensemble", 5, SMALL)
    assert got["model"] == "ensemble" and got["holdout_rows"] == 20 and got["mean_loss"] > 0
