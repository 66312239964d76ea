"""Joins whose cardinality is asserted inside the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest estimated size of a right side that is sent to all executors.
BROADCAST_BYTES = 64 * 2**20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the optimizer's size estimate is below ``limit``.

    The estimate is an upper bound for scans and projections of files. Beyond
    it, the join is left to Catalyst, which shuffles.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit else df


def unique_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df`` with a check, run where it is used, that no key repeats.

    Grouping on the keys makes uniqueness provable to the optimizer, so a left
    join none of whose columns is used is dropped.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.first(F.struct(*rest)) if rest else F.lit(True)
    one = df.groupBy(*keys).agg(packed.alias("_r"), F.count("*").alias("_n"))
    message = F.concat(F.lit(f"{name} has duplicate keys: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    ok = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return one.filter(ok).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str = "m:1", how: str = "left", name: str = "right side") -> DataFrame:
    """Join that fails if the keys are not unique where ``validate`` says so."""
    if validate not in ("m:1", "1:1"):
        raise ValueError("validate is 'm:1' or '1:1'")
    if validate == "1:1":
        left = unique_by(left, keys, "left side")
    return left.join(unique_by(right, keys, name), keys, how)
