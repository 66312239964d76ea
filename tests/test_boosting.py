"""The distributed learner against exhaustive searches, and its models in other forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.metrics import NAMES, QUANTILES
from shelfcast.operators import boosting, forecaster, learner, shap
from shelfcast.operators.learner import BoostConfig, best_split

KEYS = ["day"]


def _rows(n=600, leads=(0,), seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for lead in leads:
        for i in range(n):
            a, b, c = float(rng.integers(0, 12)), float(rng.normal()), float(rng.integers(0, 6))
            out.append((lead, i, float(max(0, a * (c in (1, 4)) + lead + rng.normal())), a, round(b, 1), c))
    return out


SCHEMA = "lead int, day int, sales_count double, a double, b double, c double"


def _naive(rows, quantile, config, categorical, edges):
    """Best-first boosting in memory: each leaf tries every cut of every feature by itself."""
    x = np.array([r[3:] for r in rows])
    y = np.log1p(np.array([r[2] for r in rows]))
    now = np.full(len(y), np.quantile(y, quantile))
    values = []
    for _ in range(config.rounds):
        g = np.where(y > now, quantile, quantile - 1)

        def split(at, depth):
            best = None
            if config.depth is not None and depth >= config.depth:
                return None
            worth = lambda m: g[m].sum() ** 2 / (m.sum() + config.l2)
            for f in range(x.shape[1]):
                if f in categorical:
                    kinds = sorted(set(x[at, f]), key=lambda v: (g[at & (x[:, f] == v)].sum() / ((at & (x[:, f] == v)).sum() + config.l2), v))
                    cuts = [at & np.isin(x[:, f], kinds[:k]) for k in range(1, len(kinds))]
                else:
                    cuts = [at & (x[:, f] <= e) for e in edges[f]]
                for left in cuts:
                    right = at & ~left
                    if min(left.sum(), right.sum()) < config.min_leaf:
                        continue
                    gain = worth(left) + worth(right) - worth(at)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, left, right)
            return best

        leaves = [(np.ones(len(y), bool), 0)]
        while len(leaves) < config.leaves:
            found = [(s[0], -k, s) for k, (at, depth) in enumerate(leaves) if (s := split(at, depth))]
            if not found:
                break
            _, k, s = max(found, key=lambda t: t[:2])
            depth = leaves.pop(-k)[1]
            leaves += [(s[1], depth + 1), (s[2], depth + 1)]
        if len(leaves) == 1:
            break
        for at, _ in leaves:
            now[at] += config.learning_rate * np.quantile((y - now)[at], quantile)
        values.append(now.copy())
    return now


@pytest.mark.parametrize("small", [False, True])
def test_fit_equals_an_exhaustive_search(spark, monkeypatch, small):
    if small:  # many blocks, leaves narrowed down in several passes, forecasts written every round
        monkeypatch.setattr(boosting, "BLOCK", 100)
        monkeypatch.setattr(boosting, "GATHER", 8)
        monkeypatch.setattr(boosting, "STATE_EVERY", 1)
    leads = (0, 3)
    rows = _rows(leads=leads)
    config = BoostConfig(rounds=3, leaves=6, depth=4, min_leaf=15)
    df = spark.createDataFrame(rows, SCHEMA)
    models = boosting.fit_models(df, ["a", "b", "c"], KEYS, config, ["c"])
    edges = boosting.bin_edges(df, ["a", "b", "c"], ["c"], config.bins)
    for lead in leads:
        mine = [r for r in rows if r[0] == lead]
        x = np.array([r[3:] for r in mine])
        for m in models[lead]:
            assert (m.n_rows, len(m.trees)) == (600, 3) and all((t.feature < 0).sum() <= 6 for t in m.trees)
            assert np.allclose(m.predict(x), _naive(mine, m.quantile, config, {2}, edges), atol=1e-9)
    assert any(c is not None for m in models[0] for t in m.trees for c in t.cats)


@pytest.mark.parametrize("sampled", [False, True])
def test_small_models_are_grown_by_one_task_as_by_passes(spark, monkeypatch, sampled):
    rows = _rows(300, (0, 2)) + _rows(900, (5,), seed=2)
    config = BoostConfig(rounds=2, leaves=4, depth=2, min_leaf=15, **({"bagging_fraction": 0.7, "bagging_freq": 1, "feature_fraction": 0.7} if sampled else {}))
    df = spark.createDataFrame(rows, SCHEMA)
    asked = []
    met = boosting._met
    monkeypatch.setattr(boosting, "_met", lambda *a: asked.append(1) or met(*a))

    def told(gather):
        monkeypatch.setattr(boosting, "GATHER", gather)
        asked.clear()
        models = boosting.fit_models(df, ["a", "b", "c"], KEYS, config, ["c"])
        return sorted(models), sorted(boosting.model_table(spark, models, ["a", "b", "c"]).collect(), key=repr), len(asked)

    near, mixed, passes = told(65_536), told(150), told(20)
    assert near[:2] == mixed[:2] == passes[:2] and near[0] == [0, 2, 5]
    assert near[2] == 0 and mixed[2] > 0 and passes[2] > 0


def test_no_task_holds_the_rows_of_a_model(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 64)
    df = spark.createDataFrame(_rows(1000), SCHEMA)
    blocks = boosting._blocks(df, ["a"], KEYS, [np.array([3.0])], frozenset(), {0: 1000}, True).collect()
    sizes = [len(b.y) // 8 for b in blocks]
    assert sum(sizes) == 1000 and max(sizes) <= 64 and len(blocks) >= 16
    assert len({x for b in blocks for x in np.frombuffer(b.h, np.int64).tolist()}) == 1000


def test_blocks_take_no_more_tasks_than_there_are(spark, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 256)
    df = spark.createDataFrame(_rows(600), SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        blocks = boosting._blocks(df, ["a"], KEYS, [np.array([3.0])], frozenset(), {0: 600}, True)
        assert blocks.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(len(b.y) // 8 for b in blocks.collect()) == 600


def test_a_category_split_is_the_best_of_all_subsets():
    rng = np.random.default_rng(4)
    for _ in range(20):
        c = rng.integers(1, 30, 6)
        a = np.array([rng.integers(0, n + 1) for n in c])
        q, n, above = 0.75, int(c.sum()), int(a.sum())
        worth = lambda k, m: (k - (1 - q) * m) ** 2 / m if m else 0.0
        want = max(worth(a[list(s)].sum(), c[list(s)].sum()) + worth(above - a[list(s)].sum(), n - c[list(s)].sum()) - worth(above, n) for r in range(1, 6) for s in itertools.combinations(range(6), r))
        got = best_split(c[None], a[None], n, above, q, BoostConfig(l2=0.0, min_leaf=1), [0], frozenset({0}), [6])
        assert got.gain == pytest.approx(want) if want > 1e-9 else got is None


def test_growth_picks_the_leaf_of_most_gain():
    """Levels at once give the tree that one split after another gives."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        config = BoostConfig(leaves=int(rng.integers(2, 12)), depth=None, min_leaf=1)
        gains: dict = {}

        def split(n, path):
            if n < 2 or rng.random() < 0.1:
                return None
            return learner.Split(float(rng.random()), 0, 0, None, int(rng.integers(1, n)))

        g = learner.Growing(500, config)
        paths = {0: ()}
        while w := g.wanted():
            for at in w:
                g.splits[at] = gains.setdefault(paths.get(at, at), split(g.sizes[at], at))
            for at, (lo, hi) in g.children.items():
                paths |= {lo: (*paths[at], 0), hi: (*paths[at], 1)}
        open_, picked = [0], []
        while len(picked) < config.leaves - 1:
            able = [at for at in open_ if g.splits.get(at)]
            if not able:
                break
            at = max(able, key=lambda k: g.splits[k].gain)
            picked.append(at)
            open_.remove(at)
            open_ += g.children[at]
        assert g.chosen() == picked


def _enumerated(tree, x, f_count):
    """Shapley values of one row by their definition."""

    def known(k, subset):
        if tree.feature[k] < 0:
            return tree.value[k]
        lo, hi = (int(c) for c in tree.below[k])
        if tree.feature[k] in subset:
            goes = bool(tree.left(k, x[None, tree.feature[k]], False)[0])
            return known(lo if goes else hi, subset)
        return (tree.cover[lo] * known(lo, subset) + tree.cover[hi] * known(hi, subset)) / tree.cover[k]

    out = np.zeros(f_count)
    for f in range(f_count):
        rest = [g for g in range(f_count) if g != f]
        for r in range(f_count):
            for s in itertools.combinations(rest, r):
                w = math.factorial(r) * math.factorial(f_count - r - 1) / math.factorial(f_count)
                out[f] += w * (known(0, {*s, f}) - known(0, set(s)))
    return known(0, set()), out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = _rows(900)
    df = spark.createDataFrame(rows, SCHEMA)
    config = BoostConfig(rounds=6, leaves=9, depth=None, min_leaf=10, bagging_fraction=0.7, bagging_freq=2, feature_fraction=0.7)
    return df, rows, boosting.fit_models(df, ["a", "b", "c"], KEYS, config, ["c"])


def test_shapley_values_equal_enumeration(fitted):
    _, rows, models = fitted
    x = np.array([r[3:] for r in rows[:40]])
    for m in models[0]:
        for t in m.trees:
            got = np.zeros(x.shape)
            t.explain(x, got)
            for i in range(len(x)):
                base, want = _enumerated(t, x[i], 3)
                assert base == pytest.approx(t.mean()) and np.allclose(got[i], want, atol=1e-12)
        base, s = m.explain(x)
        assert np.allclose(base + s.sum(axis=1), m.predict(x), atol=1e-9)
    depths = {len(path) for m in models[0] for t in m.trees for _, path in t.paths()}
    assert len(depths) > 2  # unbalanced, with features that come twice on a path


def test_sampling_is_by_hash(spark, fitted):
    df, rows, models = fitted
    config = BoostConfig(bagging_fraction=0.7, bagging_freq=2, feature_fraction=0.7)
    h = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    bags = [boosting.bagged(h, k, config) for k in range(4)]
    assert abs(bags[0].mean() - 0.7) < 0.02 and (bags[0] == bags[1]).all() and (bags[1] != bags[2]).any()
    assert {len(boosting.tree_features(k, 10, config)) for k in range(9)} == {7} and len({tuple(boosting.tree_features(k, 10, config)) for k in range(9)}) > 1
    assert all(t.cover[0] < 900 for m in models[0] for t in m.trees)
    again = boosting.fit_models(df.repartition(7, "day"), ["a", "b", "c"], KEYS, BoostConfig(rounds=6, leaves=9, depth=None, min_leaf=10, bagging_fraction=0.7, bagging_freq=2, feature_fraction=0.7), ["c"])
    x = np.array([r[3:] for r in rows])
    assert all(np.array_equal(p.predict(x), q.predict(x)) for p, q in zip(models[0], again[0], strict=True))


def test_models_as_tables_and_columns(spark, fitted):
    df, rows, models = fitted
    x = np.array([r[3:] for r in rows] + [[-1.0, math.nan, 99.0]])
    table = boosting.model_table(spark, models, ["a", "b", "c"])
    back = boosting.models_of(table, ["a", "b", "c"])
    x[-1, 1] = -1.0  # missing values of features are -1
    more = df.unionByName(spark.createDataFrame([(0, 900, None, None, math.nan, 99.0)], SCHEMA))
    got = {r.day: r for r in boosting.scored(more, back[0], ["a", "b", "c"], list(NAMES)).collect()}
    for m, b, n in zip(models[0], back[0], NAMES, strict=True):
        want = m.predict(x)
        assert np.array_equal(want, b.predict(x))
        assert np.allclose([got[i][n] for i in range(len(x))], want, rtol=0, atol=1e-12)
        assert np.allclose(b.explain(x)[1], m.explain(x)[1])
    with pytest.raises(ValueError, match="names of inputs"):
        boosting.scored(df.withColumn("x0", F.lit(1)), models[0], ["a"], list(NAMES))


def test_nothing_to_fit(spark):
    assert boosting.fit_models(spark.createDataFrame([], SCHEMA), ["a"], KEYS) == {}
    one = boosting.fit_models(spark.createDataFrame([(0, 1, 5.0, None, 0.0, 0.0), (0, 2, None, 1.0, 0.0, 0.0)], SCHEMA), ["a", "c"], KEYS, BoostConfig(rounds=3), ["c"])
    assert [(m.n_rows, m.trees, round(m.start, 9)) for m in one[0]] == [(1, [], round(math.log1p(5.0), 9))] * 4
    with pytest.raises(ValueError, match="categories"):
        boosting.bin_edges(spark.range(5000).selectExpr("double(id) AS c"), ["c"], ["c"], 8)


def test_order_of_bits_is_that_of_doubles():
    v = np.array([-np.inf, -5.0, -1e-300, -0.0, 0.0, 1e-300, 2.0, np.inf])
    assert (np.diff(boosting._sortable(v).astype(object)) >= 0).all() and np.array_equal(boosting._doubles(boosting._sortable(v)), v)


def test_the_source_of_a_crossed_quantile_is_told(spark):
    """Sorting moves a model's forecast to another quantile; its explanation goes along."""
    flat = lambda q, v: learner.Boosted(q, v)
    models = [flat(q, v) for q, v in zip(QUANTILES, (0.0, 2.0, 1.0, 3.0), strict=True)]
    told = shap.shap_long(spark.createDataFrame([(1, 10.0), (2, 70.0)], "id int, x double"), models, ["x"], ["id"])
    assert {(r.quantile, r.source_quantile) for r in told.collect()} == {(0.25, 0.25), (0.5, 0.75), (0.75, 0.5), (0.95, 0.95)}
    assert shap.additivity(told).first().off == 0


def test_bulk_features_equal_those_of_one_series():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 40, (50, 57)).astype(float) * (rng.random((50, 57)) < 0.8)
    h[::3, -1] = 0
    for i in range(50):
        one = h[i]
        past = one[-29:-1]
        positive = past[past > 0]
        flag = one[-1] == 0 and len(positive) >= 3 and np.median(positive) >= 5 and len(positive) / len(past) >= 0.5
        want = [one[-1], one[-7], one[-14], one[-28], one[-7:].mean(), one[-7:].std(), one[-28:].mean(), one[-28:].std(), float(flag)]
        assert np.allclose(forecaster.features_for_next(h)[i], want)
