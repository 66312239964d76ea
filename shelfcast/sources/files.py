"""Reading and writing: typed CSV, Parquet, JSON, submissions and exports."""

from __future__ import annotations

import json
import time
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import NAMES
from .schemas import SOURCES
from .shared import names_in, place, replace_text

#: File of each source; traffic is optional and lies in the context folder.
FILES = {"history": "sales_history.csv", "test": "test.csv", "items": "items.csv", "stores": "stores.csv", "events": "events.csv", "oil": "oil_prices.csv"}
TRAFFIC = "store_traffic.csv"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = place(spark, path)
    return fs.exists(p)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed scan; a value that does not parse fails the read. Quotes are doubled inside cells."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("escape", '"').option("dateFormat", "yyyy-MM-dd").csv(path)


#: Columns of :func:`in_file_order`: their order is that of lines.
LINE = ["_file", "_start", "_line"]


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows of a scan of text files with what tells their place: file, block and rank inside it.

    Files are in the order of their paths, as parts of one table are written. A block is read by
    one task in its order, so no task reads it all to keep lines in order. Must be next to the scan.
    """
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})


def parse_date(column: str = "date"):
    """A strict ISO day; anything else raises."""
    return F.to_date(F.col(column), "yyyy-MM-dd")


def require(spark: SparkSession, paths: list[str]) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def scan_sources(spark: SparkSession, data_dir: str, context_dir: str | None = None) -> dict[str, DataFrame]:
    """The typed tables of a folder, and traffic if a context folder is given."""
    wanted = {k: f"{data_dir}/{f}" for k, f in FILES.items()}
    sample = f"{data_dir}/sample_submission.csv"
    traffic = f"{context_dir}/{TRAFFIC}" if context_dir else None
    require(spark, [*wanted.values(), sample, *([traffic] if traffic else [])])
    out = {k: scan_csv(spark, p, SOURCES[k]) for k, p in wanted.items()}
    inferred = spark.read.option("header", True).option("inferSchema", True).csv(sample)
    out["sample"] = inferred.withColumn("id", F.col("id").cast("long"))
    if traffic:
        out["traffic"] = scan_csv(spark, traffic, SOURCES["traffic"])
    return out


def write_parquet(df: DataFrame, path: str, expected_rows: int | None = None, compression: str = "zstd", figures: dict[str, Column] | None = None) -> dict:
    """Write once and verify what was written; returns rows, first and last day, and ``figures``.

    Figures are aggregates without distinct that the write observes as rows pass. The files are
    not scanned again: their columns and numbers of rows come from their footers.
    """
    aggs = {n: c for n, c in (figures or {}).items() if n not in ("n_rows", "first_day", "last_day")}
    if "date" in df.columns:  # as numbers of days: the driver gets plain values
        aggs |= {n: F.unix_date(c("date").cast("date")) for n, c in (("first_day", F.min), ("last_day", F.max))}
    seen = Observation()
    df.observe(seen, F.count("*").alias("n_rows"), *[c.alias(n) for n, c in aggs.items()]).write.mode("overwrite").option("compression", compression).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.columns != df.columns:
        raise ValueError("written columns differ from those asked for")
    got = {n: date(1970, 1, 1) + timedelta(v) if n in ("first_day", "last_day") and v is not None else v for n, v in seen.get.items()}
    there = back.count()
    if there != got["n_rows"] or there != (there if expected_rows is None else expected_rows):
        raise ValueError(f"written {there} rows, not {got['n_rows'] if expected_rows is None else expected_rows}")
    return got


def write_submission(df: DataFrame, path: str) -> None:
    """CSV with six decimals; an existing path is an error."""
    df.select("id", *[F.format_string("%.6f", F.col(n)).alias(f"sales_count_{n}") for n in NAMES]).write.mode("errorifexists").option("header", True).csv(path)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    names = ["id", *[f"sales_count_{n}" for n in NAMES]]
    if raw.columns != names:
        raise ValueError(f"columns are {raw.columns}, not {names}")
    return raw.select("id", *[F.col(f"sales_count_{n}").cast("double").alias(n) for n in NAMES])


def write_shap(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_shap_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, quantile, base and the contributions found by their prefix."""
    raw = spark.read.option("header", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path)
    numbers = [c for c in raw.columns if c.startswith("contrib_") or c in ("quantile", "base_units", "base_value", "prediction", "display_base", "display_prediction")]
    return raw.select("id", *[F.col(c).cast("double").alias(c) for c in numbers])


def write_exceptions(exported: DataFrame, path: str) -> None:
    """The nine columns of ``review.exported``, every cell quoted."""
    columns = ["id", "store_id", "product_id", "date", "promotion", "flag", "severity", "action", "detail"]
    exported.select(columns).write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_display(told: DataFrame, path: str) -> None:
    """Explanations as shown (``shap.display_rows``), as CSV."""
    told.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json(spark: SparkSession, report: dict, path: str) -> None:
    """Sorted keys, two spaces; replaces the file in one step, in whatever file system it is."""
    replace_text(spark, path, json.dumps(report, indent=2, sort_keys=True, default=str) + "\n")


def newest(spark: SparkSession, folder: str, suffix: str) -> str:
    """The last by name of what ends with ``suffix``: names begin alike and go on with a time."""
    found = [n for n in names_in(spark, folder) if n.endswith(suffix)]
    if not found:
        raise FileNotFoundError(f"no {suffix} in {folder}")
    return f"{folder}/{found[-1]}"


def unique_path(folder: str, stem: str, suffix: str = "") -> str:
    return f"{folder}/{stem}_{time.strftime('%Y%m%dT%H%M%S')}_{uuid.uuid4().hex[:6]}{suffix}"


def write_model(nodes: DataFrame, path: str) -> None:
    """Fitted models as a table of their nodes (``boosting.model_table``)."""
    nodes.write.mode("errorifexists").option("compression", "zstd").parquet(path)
