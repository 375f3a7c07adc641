"""``python -m tidemark.cli STORE STREAM [FROM TO]``: the windows of a stream, and the count of an interval."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources.store import Store


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("store")
    p.add_argument("stream", type=int)
    p.add_argument("interval", type=int, nargs="*", metavar="TIME")
    p.add_argument("--kind", default="COUNT", choices=("COUNT", "SUM", "MEAN", "MAX", "DISTINCT"))
    p.add_argument("--confidence", type=float, default=0.95)
    told = p.parse_args(arguments)
    if len(told.interval) not in (0, 2):
        p.error("an interval has a first and a last time")
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, told.store, readonly=True)
    store.describe().filter(f"stream_id = {told.stream}").show(1000, False)
    if told.interval:
        ask = spark.createDataFrame([(0, told.stream, *told.interval)], "qid long, stream_id long, l long, r long")
        store.query(ask, told.kind, told.confidence).drop("qid").show(truncate=False)


if __name__ == "__main__":
    main()
