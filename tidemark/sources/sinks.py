"""Results as files: tables with tabs, distributions, and workloads or profiles to be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate


def write_tsv(frame: DataFrame, path: str) -> None:
    """Parts with a head line each, columns parted by tabs, in the frame's order."""
    frame.write.option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def write_cdf(frame: DataFrame, column: str, path: str, bins: int = 10_000) -> None:
    """Lines ``edge<tab>share``: the distribution of a column in equal bins from its least to its greatest value."""
    low, high = frame.agg(F.min(column), F.max(column)).first()
    if low is None:
        frame.sparkSession.createDataFrame([], "edge double, cdf double").write.option("sep", "\t").csv(path)
        return
    h = evaluate.histogram_cdf(frame, column, float(low), float(high) if high > low else float(low) + 1, bins)
    h.orderBy("bin").select("edge", "cdf").coalesce(1).write.option("sep", "\t").csv(path)  # as many rows as bins


def csv_to_parquet(spark: SparkSession, path: str, out: str) -> None:
    """A trace of lines ``ts,value`` as Parquet, once and for all."""
    spark.read.csv(path, schema="ts long, value long", comment="#").dropna().write.parquet(out)
