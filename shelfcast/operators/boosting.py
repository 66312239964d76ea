"""Fitting boosted quantile models to tables: histograms are summed by Spark.

All models (one a lead and quantile) grow side by side, one pass a level of their
trees, however many models there are. A pass reads blocks of binned rows; each task walks the trees that
the driver knows, counts rows and rows above the forecast by (leaf, feature, bin)
and passes on one histogram a leaf it has seen; these are added up and the best split of each leaf is found
where they meet. The driver gets one row a leaf. When the trees are grown, their
leaves take the exact quantile of what is left of the targets in them.

A model of NEAR rows at most is grown by one task from its blocks, one task a lead and quantile,
by the same steps; so many small models cost one job, not one a level.
No task holds the rows of a larger model: blocks have BLOCK rows at most, spread by a hash
of the key. Residuals of a leaf meet only where it has GATHER at most; larger
leaves are first narrowed down by counting the bits of the value looked for.
Every STATE_EVERY rounds the forecasts are written beside the rows, so that a pass walks few
trees and a lost executor costs one pass of its blocks.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.metrics import QUANTILES
from ..sources.shared import discard, importable, written
from .learner import BoostConfig, Boosted, Growing, Split, Tree, best_split

C = F.col
#: Rows of a block; residuals of a leaf that may meet in one task.
BLOCK, GATHER = 16_384, 65_536
#: Rows of a model that one task grows by itself, as a multiple of GATHER; larger ones take passes.
NEAR = 2
#: Bits that one narrowing pass tells of a value.
DIGIT = 12
#: Rounds between two writes of the forecasts; bytes of histograms or residuals a task holds.
STATE_EVERY, HELD_BYTES = 4, 128 * 2**20
#: Categories of a feature: a histogram has a bin for each.
MOST_CATEGORIES = 4096
_BLOCKS = "lead int, x binary, y binary, h binary, now binary"


def bin_edges(rows: DataFrame, columns: list[str], categorical: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins, from quantiles of all rows; of a categorical
    one its values. As many numbers as bins, whatever the rows."""
    numeric = [c for c in columns if c not in categorical]
    share = [k / bins for k in range(1, bins)]
    cuts = rows.agg(*[F.percentile_approx(c, share, 100 * bins).alias(c) for c in numeric]).first().asDict() if numeric else {}
    out = []
    for c in columns:
        if c in categorical:
            values = [r[0] for r in rows.select(c).distinct().limit(MOST_CATEGORIES + 1).collect()]
            if len(values) > MOST_CATEGORIES:
                raise ValueError(f"{c} has over {MOST_CATEGORIES} categories: give it as a number")
            out.append(np.array(sorted(values), np.float64))
        else:
            out.append(np.unique(np.array(cuts[c] or [], np.float64)))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray], categorical: frozenset[int]) -> np.ndarray:
    out = np.empty(x.shape, np.uint16)
    for k, e in enumerate(edges):
        at = np.searchsorted(e, x[:, k], "left")
        if k in categorical:  # what was never seen is a bin of its own
            at = np.where((at < len(e)) & (e[np.minimum(at, len(e) - 1)] == x[:, k]), at, len(e)) if len(e) else np.zeros(len(x), int)
        out[:, k] = at
    return out


def _arrow(spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(spec))


def _blocks(rows: DataFrame, columns: list[str], keys: list[str], edges: list[np.ndarray], categorical: frozenset[int], sizes: dict[int, int], log_sales: bool) -> DataFrame:
    """Binned rows in blocks; a row's block follows from its key alone."""
    counts = {lead: math.ceil(n / (BLOCK * 0.9)) for lead, n in sizes.items()}
    many = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])
    tasks = min(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), max(1, sum(counts.values())))
    row = F.xxhash64("lead", *keys)
    rows = rows.select("lead", *keys, *[C(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)], C("sales_count").cast("double").alias("_y"), row.alias("_h"))
    rows = rows.withColumn("_block", F.pmod(F.shiftrightunsigned("_h", 20), F.element_at(many, C("lead"))))
    spread = rows.repartition(tasks, "lead", "_block").sortWithinPartitions("lead", "_block", *keys)
    schema = _arrow(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: tuple[int, int] | None = None

        def block() -> Iterator[pa.RecordBatch]:
            part = np.concatenate(held)
            held.clear()
            for lo in range(0, len(part), BLOCK):
                p = part[lo : lo + BLOCK]
                y = np.log1p(p["y"]) if log_sales else p["y"]
                cols = [[at[0]], [binned(p["x"], edges, categorical).tobytes()], [np.ascontiguousarray(y).tobytes()], [np.ascontiguousarray(p["h"]).tobytes()], [b""]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        kind = np.dtype([("x", np.float64, (len(columns),)), ("y", np.float64), ("h", np.int64)])
        for batch in batches:
            part = np.empty(batch.num_rows, kind)
            for k in range(len(columns)):
                part["x"][:, k] = np.nan_to_num(batch.column(f"_x{k}").to_numpy(zero_copy_only=False), nan=-1.0)
            part["y"], part["h"] = batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_h").to_numpy(zero_copy_only=False)
            lead, number = batch.column("lead").to_numpy(), batch.column("_block").to_numpy()
            edge = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (number[1:] != number[:-1]), True]) if len(lead) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if at != (lead[lo], number[lo]):
                    if held:
                        yield from block()
                    at = (int(lead[lo]), int(number[lo]))
                held.append(part[lo:hi])
        if held:
            yield from block()

    return spread.drop(*keys).mapInArrow(run, _BLOCKS)


class _Block:
    """One block as arrays; forecasts are those written and the trees since."""

    def __init__(self, row: dict, width: int, starts: list[float], since: list[list[Tree]]):
        self.y = np.frombuffer(row["y"], np.float64)
        self.x = np.frombuffer(row["x"], np.uint16).reshape(len(self.y), width)
        self.h = np.frombuffer(row["h"], np.int64)
        self.now = np.frombuffer(row["now"], np.float64).reshape(len(QUANTILES), -1).copy() if row["now"] else np.tile(np.array(starts)[:, None], (1, len(self.y)))
        for k, trees in enumerate(since):
            for t in trees:
                self.now[k] += t.value[t.leaf(self.x, True)]


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    z = h.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bagged(h: np.ndarray, number: int, config: BoostConfig) -> np.ndarray | None:
    """Rows of a round, by a hash of their key and the round; None: all of them."""
    if config.bagging_freq < 1 or config.bagging_fraction >= 1:
        return None
    return _mix(h, config.seed + number // config.bagging_freq) < np.uint64(int(config.bagging_fraction * (2**64 - 1)))


def tree_features(number: int, width: int, config: BoostConfig) -> list[int]:
    """Features of a round's trees: the first by a hash of the round."""
    m = max(1, math.ceil(config.feature_fraction * width))
    order = _mix(np.arange(width, dtype=np.int64), config.seed * 1_000_003 + number)
    return sorted(np.argsort(order, kind="stable")[:m].tolist())


def _pass(blocks: DataFrame, width: int, starts: dict, since: dict, each, spec: str) -> DataFrame:
    """``each(block, lead, k)`` -> {node: array}; arrays of a task's blocks are joined
    by ``join`` of the first ones' type and leave as (lead, k, node, data)."""
    schema = _arrow(spec)
    work, join = each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lead, k, node), parts in held.items():
                cols = [[lead], [k], [node], [join(parts).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                lead = row["lead"]
                block = _Block(row, width, starts[lead], since[lead])
                for k in range(len(QUANTILES)):
                    for node, data in work(block, lead, k).items():
                        have = held.setdefault((lead, k, node), [])
                        have.append(data)
                        size += data.nbytes
                        if len(have) > 1 and join is _added:
                            held[lead, k, node] = [join(have)]
                            size -= data.nbytes
                if size > HELD_BYTES:
                    yield from out()
                    size = 0
        yield from out()

    return blocks.mapInArrow(run, spec)


def _added(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.sum(parts, axis=0, dtype=parts[0].dtype)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts)


_SENT = "lead int, k int, node int, data binary"
#: Nodes whose data meet in one task, about.
TOGETHER = 64


def _met(sent: DataFrame, nodes: int, kind, join, told, spec: str) -> list:
    """Collected rows of ``told(key, data)`` for each (lead, k, node): one small row a node.

    ``data`` is what all tasks sent of it, as numbers of ``kind``, put together by ``join``.
    """
    schema = _arrow(spec)
    tasks = min(max(1, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))), math.ceil(nodes / TOGETHER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, rows = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                k = (r["lead"], r["k"], r["node"])
                if k != key:
                    if parts:
                        rows.append((*key, *told(key, join(parts))))
                    key, parts = k, []
                parts.append(np.frombuffer(r["data"], kind))
                if join is _added:
                    parts = [join(parts)]
        if parts:
            rows.append((*key, *told(key, join(parts))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return sent.repartition(tasks, "lead", "k", "node").sortWithinPartitions("lead", "k", "node").mapInArrow(run, spec).collect()


def _sortable(v: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers of the same order."""
    bits = v.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _doubles(v: np.ndarray) -> np.ndarray:
    return np.where(v >> np.uint64(63), v ^ np.uint64(1 << 63), ~v).view(np.float64)


class _Growth:
    """Rounds of models by (lead, quantile), wherever their blocks are: ``_meet`` asks them."""

    def __init__(self, config: BoostConfig, columns: list[str], edges: list[np.ndarray], categorical: frozenset[int], sizes: dict[int, int], ks: list[int]):
        self.config, self.columns, self.edges, self.categorical, self.sizes = config, columns, edges, categorical, sizes
        self.wanted = [(lead, k) for lead in sizes for k in ks]
        self.width = max(len(e) for e in edges) + 1
        self.used = [len(e) + (k not in categorical) for k, e in enumerate(edges)]
        self.since: dict[int, list[list[Tree]]] = {lead: [[] for _ in QUANTILES] for lead in sizes}
        self.starts = {lead: [0.0] * len(QUANTILES) for lead in sizes}

    def grow(self) -> dict[tuple[int, int], Boosted]:
        first = self._quantiles({m: {0: self.sizes[m[0]]} for m in self.wanted}, {}, None)
        for lead, k in self.wanted:
            self.starts[lead][k] = first[lead, k, 0]
        self.models = {(lead, k): Boosted(QUANTILES[k], self.starts[lead][k], self.sizes[lead]) for lead, k in self.wanted}
        for number in range(self.config.rounds):
            if not self._round(number):
                break
        return self.models

    def _meet(self, work, join, nodes: int, kind, told, spec: str) -> list:
        """Rows of ``told(key, data)`` for each (lead, k, node) that ``work`` gives data of."""
        raise NotImplementedError

    def _grown(self, number: int, trees: dict) -> None:
        """Count the trees of a round in."""
        raise NotImplementedError

    def _round(self, number: int) -> bool:
        config, columns = self.config, tree_features(number, len(self.columns), self.config)
        sizes = self.sizes
        if config.bagging_freq > 0 and config.bagging_fraction < 1:
            sizes = self._counted(number)
        growing = {(lead, k): Growing(sizes.get(lead, 0), config) for lead, k in self.wanted}
        while wanted := {m: w for m, g in growing.items() if (w := g.wanted())}:
            for (lead, k, node), split in self._splits(number, columns, growing, wanted).items():
                growing[lead, k].splits[node] = split
        trees = {m: g.tree(self.edges) for m, g in growing.items() if g.chosen()}
        if not trees:
            return False
        leaves = {m: {int(at): int(t.cover[at]) for at in np.flatnonzero(t.feature < 0)} for m, t in trees.items()}
        values = self._quantiles(leaves, trees, number)
        for m, t in trees.items():
            for at in leaves[m]:
                t.value[at] = config.learning_rate * values[*m, at]
            self.models[m].trees.append(t)
        self._grown(number, trees)
        return True

    def _counted(self, number: int) -> dict[int, int]:
        config, first = self.config, self.wanted[0][1]

        def work(block: _Block, lead: int, k: int) -> dict[int, np.ndarray]:
            return {0: np.array([bagged(block.h, number, config).sum()], np.int64)} if k == first else {}

        return {r.lead: r.n for r in self._meet(work, _added, len(self.sizes), np.int64, lambda key, n: (int(n[0]),), "lead int, k int, node int, n long")}

    def _splits(self, number: int, features: list[int], growing: dict, wanted: dict) -> dict:
        """Best split of each wanted node, or None."""
        config, width, used, categorical = self.config, self.width, self.used, self.categorical
        partial = {m: growing[m].tree(self.edges, True) for m in wanted}
        places = {m: {node: i for i, node in enumerate(w)} for m, w in wanted.items()}

        def work(block: _Block, lead: int, k: int) -> dict[int, np.ndarray]:
            if (lead, k) not in partial:
                return {}
            t, place = partial[lead, k], places[lead, k]
            slot = np.array([place.get(o, -1) for o in t.opened])[t.leaf(block.x, True)]
            take = slot >= 0
            bag = bagged(block.h, number, config)
            if bag is not None:
                take &= bag
            slot, x, above = slot[take], block.x[take], block.y[take] > block.now[k][take]
            n = len(place)
            at = 2 * width * slot + above
            out = np.zeros((n, len(features), width, 2), np.int64)
            for i, f in enumerate(features):
                out[:, i] = np.bincount(at + 2 * x[:, f].astype(np.int64), minlength=2 * n * width).reshape(n, width, 2)
            return {node: out[i] for node, i in place.items() if out[i, 0].any()}

        def best(key: tuple, hist: np.ndarray) -> tuple:
            hist = hist.reshape(len(features), width, 2)
            counts, above = hist.sum(axis=2), hist[:, :, 1]
            s = best_split(counts, above, int(counts[0].sum()), int(above[0].sum()), QUANTILES[key[1]], config, features, categorical, used)
            return (s.gain, s.feature, s.cut, None if s.cats is None else list(s.cats), s.n_left) if s else (None,) * 5

        out = {(lead, k, node): None for (lead, k), w in wanted.items() for node in w}
        spec = "lead int, k int, node int, gain double, feature int, cut int, cats array<int>, n_left long"
        for r in self._meet(work, _added, len(out), np.int64, best, spec):
            if r.gain is not None:
                out[r.lead, r.k, r.node] = Split(r.gain, r.feature, r.cut, None if r.cats is None else tuple(r.cats), r.n_left)
        return out

    def _quantiles(self, leaves: dict, trees: dict, number: int | None) -> dict:
        """Interpolated quantile of what is left of the targets in each leaf.

        Each needs one or two order statistics. One that lies among more than
        GATHER values is narrowed down digit by digit: values are counted by the
        next bits behind those that are known of it.
        """
        config = self.config
        targets: dict[tuple[int, int, int], list[list[int]]] = {}  # (rank among those that share the bits, bits, number of bits, how many share them)
        for (lead, k), sizes in leaves.items():
            for node, n in sizes.items():
                r = (n - 1) * QUANTILES[k]
                targets[lead, k, node] = [[x, 0, 0, n] for x in sorted({math.floor(r), math.ceil(r)})]

        def residuals(block: _Block, lead: int, k: int) -> tuple[np.ndarray, np.ndarray]:
            t = trees.get((lead, k))
            at = np.zeros(len(block.y), np.int32) if t is None else t.leaf(block.x, True)
            rest = block.y - block.now[k]
            bag = bagged(block.h, number, config) if number is not None else None
            return (at, rest) if bag is None else (at[bag], rest[bag])

        def narrow(open_: dict, gather: bool):
            def work(block: _Block, lead: int, k: int) -> dict[int, np.ndarray]:
                if (lead, k) not in leaves:
                    return {}
                at, rest = residuals(block, lead, k)
                out: dict[int, np.ndarray] = {}
                for node in np.unique(at).tolist():
                    ts = open_.get((lead, k, node), ())
                    for i, (_, bits, known, _) in enumerate(ts):
                        if i and ts[0][1:3] == [bits, known]:
                            continue  # both statistics are among the same values
                        v = _sortable(rest[at == node])
                        v = v if not known else v[v >> np.uint64(64 - known) == np.uint64(bits)]
                        if gather:
                            out[2 * node + i] = v
                        else:
                            digit = min(DIGIT, 64 - known)
                            seen = (v >> np.uint64(64 - known - digit)) & np.uint64((1 << digit) - 1)
                            out[2 * node + i] = np.bincount(seen.astype(np.int64), minlength=1 << digit)
                return out

            return work

        while wide := {m: ts for m, ts in targets.items() if any(x[3] > GATHER and x[2] < 64 for x in ts)}:
            for r in self._meet(narrow(wide, False), _added, 2 * len(wide), np.int64, lambda key, v: (v.tobytes(),), _SENT):
                ts = targets[r.lead, r.k, r.node // 2]
                upto = np.cumsum(np.frombuffer(r.data, np.int64))
                told = ts[r.node % 2][1:3]
                for x in ts[r.node % 2 :]:
                    if x[1:3] == told:
                        digit = min(DIGIT, 64 - x[2])
                        at = int(np.searchsorted(upto, x[0], "right"))
                        below = int(upto[at - 1]) if at else 0
                        x[:] = [x[0] - below, x[1] << digit | at, x[2] + digit, int(upto[at]) - below]
        ranks: dict[tuple[int, int, int], list[int]] = {}  # by what is sent: one or both statistics
        for (lead, k, node), ts in targets.items():
            for i, x in enumerate(ts):
                ranks.setdefault((lead, k, 2 * node + (i if x[1:3] != ts[0][1:3] else 0)), []).append(x[0])

        def pick(key: tuple, v: np.ndarray) -> tuple:
            return (_doubles(np.partition(v, ranks[key])[ranks[key]]).tolist(),)

        found = self._meet(narrow(targets, True), _joined, len(ranks), np.uint64, pick, "lead int, k int, node int, values array<double>")
        got = {(r.lead, r.k, r.node + i): v for r in found for i, v in enumerate(r["values"])}
        out = {}
        for (lead, k, node), ts in targets.items():
            low = got[lead, k, 2 * node]
            high = got.get((lead, k, 2 * node + 1), low)
            r = (leaves[lead, k][node] - 1) * QUANTILES[k]
            out[lead, k, node] = low + (high - low) * (r - math.floor(r))
        return out


class _Near(_Growth):
    """A model that one task grows from its blocks."""

    def __init__(self, rows: list[dict], lead: int, k: int, size: int, config: BoostConfig, columns: list[str], edges: list[np.ndarray], categorical: frozenset[int]):
        super().__init__(config, columns, edges, categorical, {lead: size}, [k])
        self.whole = {c: b"".join(r[c] for r in rows) for c in ("x", "y", "h")} | {"now": b""}
        self.block: _Block | None = None

    def _meet(self, work, join, nodes, kind, told, spec):
        lead, k = self.wanted[0]
        block = self.block or _Block(self.whole, len(self.columns), self.starts[lead], ())
        row = Row(*(c.split()[0] for c in spec.split(", ")))
        return [row(lead, k, node, *told((lead, k, node), data)) for node, data in work(block, lead, k).items()]

    def _grown(self, number, trees):
        lead, k = self.wanted[0]
        if self.block is None:
            self.block = _Block(self.whole, len(self.columns), self.starts[lead], ())
        t = trees[lead, k]
        self.block.now[k] += t.value[t.leaf(self.block.x, True)]


class Fit(_Growth):
    """The models of one table while they are fitted. See the module."""

    def __init__(self, rows: DataFrame, columns: list[str], keys: list[str], config: BoostConfig, categorical: list[str] = ()):
        at = frozenset(k for k, c in enumerate(columns) if c in categorical)
        importable(rows.sparkSession)
        filled = rows.select("lead", "sales_count", *keys, *[F.nanvl(F.coalesce(C(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)).alias(c) for c in columns if c not in keys])
        filled = written(filled, "training")  # read three times: counts, edges, blocks
        sizes = {r.lead: r.n for r in filled.groupBy("lead").agg(F.count("*").alias("n")).collect()}
        self.fitted: dict[int, list[Boosted]] = {}
        if not sizes:
            return
        edges = bin_edges(filled, columns, list(categorical), config.bins)
        self.blocks = written(_blocks(filled, columns, keys, edges, at, sizes, config.log_sales), "blocks")
        discard(filled)
        near = {lead: n for lead, n in sizes.items() if n <= NEAR * GATHER}
        super().__init__(config, columns, edges, at, {lead: n for lead, n in sizes.items() if lead not in near}, list(range(len(QUANTILES))))
        made = self._near(near) if near else {}
        if self.sizes:
            made |= self.grow()
        discard(self.blocks)
        self.fitted = {lead: [made[lead, k] for k in range(len(QUANTILES))] for lead in sizes}

    def _near(self, sizes: dict[int, int]) -> dict[tuple[int, int], Boosted]:
        """Models that are grown by one task each."""
        config, columns, edges, categorical = self.config, self.columns, self.edges, self.categorical
        places = {lead: i for i, lead in enumerate(sizes)}
        number = F.element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), C("lead")) * len(QUANTILES) + C("k")
        spec = "lead int, k int, model binary"
        schema = _arrow(spec)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held = None, []

            def model() -> pa.RecordBatch:
                grown = _Near(held, *key, sizes[key[0]], config, columns, edges, categorical).grow()[key]
                return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, pickle.dumps(grown)), schema, strict=True)], schema=schema)

            for batch in batches:
                for row in batch.to_pylist():
                    if (row["lead"], row["k"]) != key:
                        if held:
                            yield model()
                        key, held = (row["lead"], row["k"]), []
                    held.append(row)
            if held:
                yield model()

        rows = self.blocks.filter(C("lead").isin(list(sizes))).select("lead", "x", "y", "h", F.explode(F.array(*[F.lit(k) for k in range(len(QUANTILES))])).alias("k"))
        spread = rows.repartitionById(len(sizes) * len(QUANTILES), number).sortWithinPartitions("lead", "k")
        return {(r.lead, r.k): pickle.loads(r.model) for r in spread.mapInArrow(run, spec).collect()}

    def _meet(self, work, join, nodes, kind, told, spec):
        blocks = self.blocks.filter(C("lead").isin(list(self.sizes)))
        return _met(_pass(blocks, len(self.columns), self.starts, self.since, (work, join), _SENT), nodes, kind, join, told, spec)

    def _grown(self, number, trees):
        for (lead, k), t in trees.items():
            self.since[lead][k].append(t)
        if (number + 1) % STATE_EVERY == 0 and number + 1 < self.config.rounds:
            self._write()

    def _write(self) -> None:
        """Put the forecasts so far beside the rows."""
        width, starts, since = len(self.columns), self.starts, self.since
        schema = _arrow(_BLOCKS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    row["now"] = _Block(row, width, starts[row["lead"]], since[row["lead"]]).now.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        before = self.blocks
        self.blocks = written(before.filter(C("lead").isin(list(self.sizes))).mapInArrow(run, _BLOCKS), "blocks")
        discard(before)
        self.since = {lead: [[] for _ in QUANTILES] for lead in self.sizes}


def fit_models(rows: DataFrame, columns: list[str], keys: list[str], config: BoostConfig = BoostConfig(), categorical: list[str] = ()) -> dict[int, list[Boosted]]:
    """Models by lead, in the order of the quantiles, of rows (lead, keys, sales_count, columns).

    Missing values of features are -1. Rows without a target are left out.
    """
    if "lead" not in rows.columns:
        rows = rows.withColumn("lead", F.lit(0))
    return Fit(rows.filter("sales_count IS NOT NULL").withColumn("lead", C("lead").cast("int")), columns, keys, config, list(categorical)).fitted


NODES = "lead int, quantile double, n_rows long, tree int, node int, feature string, threshold double, categories array<double>, left int, right int, value double, cover long"


def model_table(spark, models: dict[int, list[Boosted]], columns: list[str]) -> DataFrame:
    """One row a node, in words of the features; the start of a model is its tree -1."""
    rows = []
    for lead, by in models.items():
        for m in by:
            rows.append((lead, m.quantile, m.n_rows, -1, 0, None, None, None, None, None, m.start, m.n_rows))
            for i, t in enumerate(m.trees):
                for k in range(len(t.feature)):
                    inner = t.feature[k] >= 0
                    cats = [float(x) for x in t.cats[k]] if t.cats[k] is not None else None
                    rows.append((lead, m.quantile, m.n_rows, i, k, columns[t.feature[k]] if inner else None, float(t.threshold[k]) if inner and cats is None else None, cats, int(t.below[k, 0]) if inner else None, int(t.below[k, 1]) if inner else None, None if inner else float(t.value[k]), int(t.cover[k])))
    return spark.createDataFrame(rows, NODES)


def models_of(table: DataFrame, columns: list[str]) -> dict[int, list[Boosted]]:
    """The models of a node table; as large as the models."""
    found: dict[int, dict[float, Boosted]] = {}
    trees: dict[tuple, list] = {}
    for r in table.collect():
        if r.tree < 0:
            found.setdefault(r.lead, {})[r.quantile] = Boosted(r.quantile, r.value, r.n_rows)
        else:
            trees.setdefault((r.lead, r.quantile, r.tree), []).append(r)
    for (lead, q, _), nodes in sorted(trees.items()):
        nodes.sort(key=lambda r: r.node)
        of = lambda f, missing: np.array([missing if f(r) is None else f(r) for r in nodes])
        feature = np.array([columns.index(r.feature) if r.feature else -1 for r in nodes], np.int32)
        t = Tree(feature, of(lambda r: r.threshold, 0.0), np.zeros(len(nodes), np.int32), [None] * len(nodes), [None if r.categories is None else np.array(r.categories) for r in nodes], np.stack([of(lambda r: r.left, -1), of(lambda r: r.right, -1)], axis=1).astype(np.int32), of(lambda r: r.value, 0.0), of(lambda r: r.cover, 0))
        found[lead][q].trees.append(t)
    return {lead: [by[q] for q in QUANTILES] for lead, by in found.items()}


def as_sql(model: Boosted) -> str:
    """A model as one SQL expression over columns x0, x1, ...: scoring then runs in the JVM.

    Values are added tree by tree, as ``predict`` adds them.
    """

    def node(t: Tree, k: int) -> str:
        if t.feature[k] < 0:
            return f"{float(t.value[k])!r}D"
        if t.cats[k] is not None:
            test = f"x{t.feature[k]} IN ({', '.join(f'{float(c)!r}D' for c in t.cats[k])})"
        else:
            test = f"x{t.feature[k]} <= {float(t.threshold[k])!r}D"
        return f"IF({test}, {node(t, int(t.below[k, 0]))}, {node(t, int(t.below[k, 1]))})"

    return " + ".join([f"{float(model.start)!r}D", *(node(t, 0) for t in model.trees)])


def scored(rows: DataFrame, models: list[Boosted], columns: list[str], names: list[str]) -> DataFrame:
    """``rows`` with one raw forecast a model, computed by column expressions alone."""
    inputs = [F.nanvl(F.coalesce(C(c).cast("double"), F.lit(-1.0)), F.lit(-1.0)).alias(f"x{k}") for k, c in enumerate(columns)]
    if clash := {f"x{k}" for k in range(len(columns))} & set(rows.columns):
        raise ValueError(f"columns {', '.join(sorted(clash))} are the names of inputs")
    return rows.select("*", *inputs).select(*rows.columns, *[F.expr(as_sql(m)).alias(n) for m, n in zip(models, names, strict=True)])
