"""Exact global order statistics without a global sort.

The range of the values is cut into cells, whose rows, smallest and largest values are
counted in one pass; of the cell that holds a wanted rank the next pass takes the range.
A rank is found when its cell holds one value only, or few enough rows to be put in order
by one small task. A pass sends at most CELLS rows a wanted rank to the driver,
whatever the input, and no task holds more than FEW values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
#: Cells a pass counts for each rank; rows of a cell that one task may put in order.
CELLS, FEW = 1024, 65_536


def at_ranks(df: DataFrame, value: Column, ranks: Callable[[int], list[int]], few: int = FEW) -> list[float | None]:
    """The values at ``ranks(n)``, from 0, of the n known values in ascending order.

    NaN is the largest value, infinities are values. Without values, or beyond them, there is None.
    """
    known = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    low, high = F.lit(-math.inf), F.lit(math.inf)
    inner = (C("v") > low) & (C("v") < high)
    ends = known.agg(F.count("*").alias("n"), F.count_if(C("v") == low).alias("low"), F.count_if(inner).alias("inner"), F.count_if(C("v") == high).alias("high"), F.min(F.when(inner, C("v"))).alias("lo"), F.max(F.when(inner, C("v"))).alias("hi")).first()
    found: dict[int, float | None] = {}
    # rank among finite values, and the closed range that holds it, with the rows before that
    open_: dict[int, tuple[float, float, int]] = {}
    wanted = ranks(ends.n)
    for r in set(wanted):
        if not 0 <= r < ends.n:
            found[r] = None
        elif r < ends.low:
            found[r] = -math.inf
        elif r >= ends.low + ends.inner:
            found[r] = math.inf if r < ends.low + ends.inner + ends.high else math.nan
        elif ends.lo == ends.hi:
            found[r] = ends.lo
        else:
            open_[r] = ends.lo, ends.hi, ends.low
    while open_:
        spans = sorted({(lo, hi) for lo, hi, _ in open_.values()})
        places = [F.when((C("v") >= lo) & (C("v") <= hi), F.struct(F.lit(k).alias("span"), _cell(lo, hi).alias("cell"))) for k, (lo, hi) in enumerate(spans)]
        cells = known.filter(reduce(lambda a, b: a | b, [(C("v") >= lo) & (C("v") <= hi) for lo, hi in spans]))
        cells = cells.select("v", F.explode(F.array_compact(F.array(*places))).alias("x")).groupBy("x.span", "x.cell").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        by: dict[int, list] = {}
        for row in cells.collect():
            by.setdefault(row.span, []).append(row)
        for r, (lo, hi, before) in list(open_.items()):
            for cell in sorted(by[spans.index((lo, hi))], key=lambda c: c.cell):
                if r < before + cell.n:
                    break
                before += cell.n
            if cell.lo == cell.hi:
                found[r] = cell.lo
            elif cell.n <= few:
                near = known.filter((C("v") >= cell.lo) & (C("v") <= cell.hi)).groupBy("v").agg(F.count("*").alias("n"))
                found[r] = _ordered(near, r - before)
            else:
                open_[r] = cell.lo, cell.hi, before
                continue
            del open_[r]
    return [found[r] for r in wanted]


def _cell(lo: float, hi: float) -> Column:
    """Place of v within lo < hi: never falls as v rises; lo is in the first cell, hi in the last, so ranges shrink."""
    # halves keep a width finite
    by = 1.0 if math.isfinite(hi - lo) else 0.5
    return F.least(F.lit(CELLS - 1), F.floor((C("v") * by - lo * by) / (hi * by - lo * by) * CELLS).cast("int"))


def element_at_share(df: DataFrame, value: Column, share: float) -> DataFrame:
    """One row, ``cutoff``: the sorted element at floor(share * n), from 0; found when this is called."""
    cutoff = at_ranks(df, value, lambda n: [min(n - 1, math.floor(n * share))])[0]
    return df.sparkSession.range(1).select(F.lit(cutoff).cast("double").alias("cutoff"))


def _ordered(counts: DataFrame, rank: int) -> float:
    """The value at a rank of few distinct ones: those of one cell."""
    for row in counts.orderBy("v").toLocalIterator():
        if rank < row.n:
            return row.v
        rank -= row.n
    raise AssertionError("a cell holds its rank")
