"""Distributed pieces of similarity joins.

From rows (bucket, node, sketch) to exact links, in steps that never compare what
no bucket brings together:

  1. Crowds. Where a row has more than FEW partners in a bucket whose sketches do
     not rule a link out, it and such partners are a crowd: they are joined by one
     edge a row. A crowd is what a group of near copies is.
  2. Pairs. All other near pairs of a bucket are told one by one: a row has few.
  3. Inside a crowd every pair is decided exactly, in blocks dealt to many tasks;
     outside, each pair is. Only links that hold are closed into components, so a
     chain of neighbours below the threshold costs its neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from .common import forget, stored

#: Rows of one block; a larger group is compared block by block in many tasks.
BLOCK = 512
#: Partners in a bucket up to which pairs are told one by one.
FEW = 8
#: Groups up to this size are worked on many at a time.
LITTLE = 32


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream sorted by ``keys`` into tables of whole groups.

    Yields (table, starts of its groups). Groups are as large as the caller's
    dealing makes them; all others wait in the stream.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table, keys)
        last = int(starts[-1])
        if last:
            yield table.slice(0, last), starts[:-1]
        held = table.slice(last).to_batches()
        size = table.num_rows - last
        rows = max(rows, 2 * size)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table, keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, for edges a-b inside a task."""
    r = np.arange(n)
    while True:
        low = np.minimum(r[a], r[b])
        new = r.copy()
        np.minimum.at(new, r[a], low)
        np.minimum.at(new, r[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == r).all():
            return r
        r = new


def components(edges: DataFrame, name: str) -> DataFrame:
    """Component of every node that has an edge: node, root (smallest node).

    ``edges`` has a and b. Each round links every node's larger neighbours and
    itself to its smallest neighbour, then every node's smaller neighbours to
    the smallest; the number of rounds grows with the logarithm of the longest
    path. Rounds are written to the shared folder; only a count and a sum reach
    the driver. A hub is the smaller end of its edges: these meet its own
    smallest neighbour in a join of two plain exchanges, which adaptive
    execution splits where one is skewed.
    """
    # the orientation larger -> smaller; loops carry nothing
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), name)
    seen = None
    while True:
        least = stored(now.groupBy("u").agg(F.min("v").alias("m")), name)
        # an edge's larger end goes to the smallest neighbour of its smaller end
        upper = now.join(small(least.select(F.col("u").alias("v"), F.col("m").alias("w"))), "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        # every node with a smaller neighbour goes to the smallest one
        large = upper.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        new = stored(linked, name)
        told = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(now)
        forget(least)
        now = new
        if told == seen:
            break
        seen = told
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def blocks(rows: DataFrame, group: str, order: str, size: int = BLOCK) -> DataFrame:
    """Deal each group's rows to pairs of blocks, so every pair of rows meets once.

    Adds i, j (the pair of blocks, i <= j), own (the block of the row) and n_rows.
    A group of one block is one task's; a group of g blocks is dealt to
    g*(g+1)/2 of them, each of which holds two blocks.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n_rows"))
    g = F.ceil(F.col("n_rows") / size).cast("int")
    own = F.pmod(F.xxhash64(order), g.cast("long")).cast("int")
    dealt = rows.join(counts, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


Kernel = Callable[[pa.Table, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def linker(kernel: Callable, group: str, node: str):
    """Compare the rows of every (group, i, j) and tell links and joins.

    ``kernel(table)`` returns an object whose ``links(x, y)`` is a boolean
    matrix for two index arrays. Yields, per node and block pair, its number of
    links weighted by the partners' ``weight``, and the smallest node it is
    joined with there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, [group, "i", "j"], rows=256):
            out_n, out_l, out_r, out_b = [], [], [], []
            stops = np.r_[starts[1:], table.num_rows]
            for lo, hi in zip(starts.tolist(), stops.tolist(), strict=True):
                part = table.slice(lo, hi - lo)
                nodes, weight, own = (part.column(c).to_numpy() for c in (node, "weight", "own"))
                i, j = part.column("i")[0].as_py(), part.column("j")[0].as_py()
                x = np.flatnonzero(own == i)
                y = x if i == j else np.flatnonzero(own == j)
                k = kernel(part)
                links = np.zeros(len(nodes), np.int64)
                ea, eb = [], []
                for s in range(0, len(x), 1024):
                    hit = k.links(x[s : s + 1024], y)
                    if i == j:
                        hit[np.arange(len(hit)), np.arange(s, s + len(hit))] = False
                    links[x[s : s + 1024]] += hit @ weight[y]
                    if i != j:
                        links[y] += hit.T @ weight[x[s : s + 1024]]
                    a, b = np.nonzero(hit)
                    ea.append(x[s : s + 1024][a])
                    eb.append(y[b])
                order = np.argsort(nodes, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                r = roots(len(nodes), place[np.concatenate(ea)], place[np.concatenate(eb)]) if ea else np.arange(len(nodes))
                out_n.append(nodes)
                out_l.append(links)
                out_r.append(nodes[order][r[place]])
                out_b.append(part.column("n_rows").to_numpy())
            yield pa.record_batch([pa.array(np.concatenate(v)) for v in (out_n, out_l, out_r, out_b)], ["node", "links", "root", "n_rows"])

    return run


def link_groups(rows: DataFrame, group: str, node: str, kernel: Callable, name: str, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Exact links inside each group: (node, links) and (node, root).

    Groups that fit one block get their roots in one task; for larger ones the
    roots of all block pairs go through :func:`components`.
    """
    dealt = blocks(rows, group, node, size)
    dealt = dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")
    told = stored(dealt.mapInArrow(linker(kernel, group, node), "node long, links long, root long, n_rows long"), name)
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    one = told.filter(F.col("n_rows") <= size).select("node", "root")
    many = told.filter(F.col("n_rows") > size).select(F.col("node").alias("a"), F.col("root").alias("b"))
    if many.isEmpty():
        return links, one
    # nodes whose only edges are loops belong to themselves: their row is absent
    return links, one.unionByName(components(many, name))


Near = Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def _close(table: pa.Table, starts: np.ndarray, near: Near, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) of the near pairs of groups of over ``least`` rows."""
    own, bi, bj = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    n = table.num_rows
    sizes = np.diff(np.r_[starts, n])
    group = np.repeat(np.arange(len(starts)), sizes)
    of = near(table)
    little = np.repeat((sizes <= LITTLE) & (sizes > least), sizes)
    for off in range(1, LITTLE):
        a = np.flatnonzero((group[off:] == group[:-off]) & little[off:])
        if not len(a):
            break
        a = a[of(a, a + off)]
        yield a, a + off
    for g in np.flatnonzero(sizes > max(LITTLE, least)).tolist():
        lo, hi = int(starts[g]), int(starts[g] + sizes[g])
        x = lo + np.flatnonzero(own[lo:hi] == bi[lo])
        y = lo + np.flatnonzero(own[lo:hi] == bj[lo])
        for s in range(0, len(x), 128):
            a, b = np.repeat(x[s : s + 128], len(y)), np.tile(y, len(x[s : s + 128]))
            if bi[lo] == bj[lo]:
                a, b = a[a < b], b[a < b]
            k = of(a, b)
            yield a[k], b[k]


def _crowd_edges(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["bucket", "i", "j"], rows=8192):
            found = list(_close(table, starts, near, FEW + 1))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            many = np.bincount(np.r_[a, b], minlength=table.num_rows) > FEW
            k = many[a] & many[b]
            # rows of a table, not nodes: a node may stand in several of its groups
            r = roots(table.num_rows, a[k], b[k])
            node = table.column("node").to_numpy()
            pairs = np.unique(np.stack([node, node[r]])[:, r != np.arange(len(r))], axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _told_pairs(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["bucket", "i", "j"], rows=8192):
            node = table.column("node").to_numpy()
            crowd = table.column("crowd").to_numpy()
            inside = table.column("in_crowd").to_numpy(zero_copy_only=False)
            for a, b in _close(table, starts, near, 0):
                k = ~(inside[a] & inside[b] & (crowd[a] == crowd[b]))
                if k.any():
                    lo, hi = np.minimum(node[a[k]], node[b[k]]), np.maximum(node[a[k]], node[b[k]])
                    pairs = np.unique(np.stack([lo, hi]), axis=1)
                    yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def candidates(rows: DataFrame, sketches: DataFrame, near: Near, name: str, size: int = 2 * BLOCK) -> tuple[DataFrame, DataFrame]:
    """Crowds (node, root) and pairs (a, b) of ``rows`` (bucket, node).

    ``sketches`` has a row a node; only rows of buckets with company meet theirs.
    ``near(table)`` gives a function of two index arrays that tells which pairs
    may be linked.
    """
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    rows = rows.join(crowded, "bucket").join(sketches, "node")
    g = F.ceil(F.col("n_rows") / size).cast("int")
    own = F.pmod(F.xxhash64("node"), g.cast("long")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    dealt = stored(dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other"), name)

    def sorted_groups(df: DataFrame) -> DataFrame:
        return df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    large = dealt.filter(F.col("n_rows") > FEW + 1)
    crowds = stored(components(sorted_groups(large).mapInArrow(_crowd_edges(near), "a long, b long"), name), name)
    inside = crowds.select("node", F.col("root").alias("crowd"), F.lit(True).alias("in_crowd"))
    marked = dealt.join(small(inside), "node", "left").withColumn("in_crowd", F.coalesce("in_crowd", F.lit(False))).withColumn("crowd", F.coalesce("crowd", F.lit(0)))
    pairs = stored(sorted_groups(marked).mapInArrow(_told_pairs(near), "a long, b long").distinct(), name)
    return crowds, pairs


def exact_links(crowds: DataFrame, pairs: DataFrame, members: DataFrame, kernel: Callable, paired: Callable, name: str) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, root) from crowds and pairs, each link decided exactly.

    ``members`` has node, weight and what ``kernel`` compares, for every node of
    either; ``kernel(table).links(x, y)`` is the boolean matrix of links, and
    ``paired(table, table)`` the links of rows side by side.
    """
    links, joined = link_groups(members.join(crowds, "node"), "root", "node", kernel, name)
    rest = [c for c in members.columns if c not in ("node", "weight")]

    def side(end: str) -> DataFrame:
        return members.select(F.col("node").alias(end), F.struct(*rest).alias(f"of_{end}"), F.col("weight").alias(f"weight_{end}"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hit = paired(*(pa.Table.from_struct_array(batch.column(c)) for c in ("of_a", "of_b")))
            yield batch.select(["a", "b", "weight_a", "weight_b"]).filter(pa.array(hit))

    held = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "weight_a", "weight_b", "of_a", "of_b").mapInArrow(decide, "a long, b long, weight_a long, weight_b long"), name)
    ends = held.select(F.col("a").alias("node"), F.col("weight_b").alias("links")).unionByName(held.select(F.col("b").alias("node"), F.col("weight_a").alias("links")))
    links = links.unionByName(ends).groupBy("node").agg(F.sum("links").alias("links"))
    edges = joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(held.select("a", "b"))
    return links, components(edges, name)
