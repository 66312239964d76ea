"""Global order statistics by refined ranges, and line order without one task."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import ranks, validation
from shelfcast.sources import files


def _at(spark, values, wanted, few=ranks.FEW):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    return ranks.at_ranks(df, F.col("v"), lambda n: wanted, few)


@pytest.mark.parametrize("few", [0, 3, ranks.FEW])
def test_ranks_equal_a_sort(spark, few):
    rng = np.random.default_rng(3)
    # heavy ties, a long tail, tiny differences, and spans of all doubles
    for values in (rng.integers(0, 5, 400).astype(float), np.exp(rng.normal(0, 12, 400)), 1 + rng.integers(0, 50, 300) * 2.0**-52, rng.choice([-1.7e308, 1.7e308, -0.5, 0.25, 3e-320, 5e-324, 0.0], 200)):
        wanted = [0, 1, 57, 150, 198, len(values) - 1, len(values), -1]
        s = sorted(values.tolist())
        assert _at(spark, values.tolist(), wanted, few) == [*[s[r] for r in wanted[:6]], None, None]


def test_values_that_are_not_finite_or_known(spark):
    values = [math.nan, None, math.inf, -math.inf, 2.0, 1.0, None, math.nan]
    got = _at(spark, values, [0, 1, 2, 3, 4, 5, 6])
    assert got[:4] == [-math.inf, 1.0, 2.0, math.inf] and math.isnan(got[4]) and math.isnan(got[5]) and got[6] is None
    assert _at(spark, [], [0]) == [None] and _at(spark, [None], [0]) == [None] and _at(spark, [4.0], [0]) == [4.0]
    assert _at(spark, [4.0] * 9, [0, 8]) == [4.0, 4.0] and _at(spark, [math.nan], [0])[0] != _at(spark, [4.0], [0])[0]


def test_cutoff_is_the_element_at_the_share(spark):
    for n in (1, 7, 100, 1000):
        df = spark.range(n).select((F.col("id") * 11 % n).cast("double").alias("v"))
        assert ranks.element_at_share(df, F.col("v"), 0.95).first().cutoff == min(n - 1, math.floor(n * 0.95))
    assert ranks.element_at_share(spark.createDataFrame([], "v double"), F.col("v"), 0.95).first().cutoff is None


def test_no_pass_orders_all_values(spark):
    """What is sorted or brought to the driver is a cell, however many rows there are."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_000).cast("double").alias("v"))
    assert ranks.at_ranks(df, F.col("v"), lambda n: [n // 3, n - 2], few=100) == [66_666.0, 199_998.0]


def test_lines_keep_their_order_in_files_of_many_blocks(spark, tmp_path):
    ids = [(k * 7919) % 5000 for k in range(5000)]
    for part in range(3):
        lines = [f"{i},{'x' * 30}" for i in ids[part * 2000 : (part + 1) * 2000]]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(["id,pad", *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        df = files.scan_csv(spark, str(tmp_path), "id long, pad string")
        assert df.rdd.getNumPartitions() > 6
        told = validation.positions(files.in_file_order(df).select("id", *files.LINE), files.LINE)
        assert [r.id for r in told.orderBy("position").collect()] == ids
        assert told.agg(F.min("position"), F.max("position"), F.count_distinct("position")).first()[:] == (0, 4999, 5000)
        inferred = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path)).withColumn("id", F.col("id").cast("long"))
        assert [r.id for r in files.in_file_order(inferred).orderBy(*files.LINE).collect()] == ids
        swapped = told.withColumn("position", F.when(F.col("position") < 2, 1 - F.col("position")).otherwise(F.col("position")))
        assert validation.ordered_equality(told, swapped).first().misplaced == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
