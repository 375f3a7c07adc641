"""Experiments: stores of several decays over the same elements, a workload, and how far its answers are off."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, evaluate, workload
from .sources.config import Config
from .sources.store import Store

#: Kinds of queries of a store by the types of a workload: fixed values.
KINDS = {"COUNT": "COUNT", "SUM": "SUM", "MEAN": "MEAN", "MAX": "MAX", "MAX_THRESH": "MAX", "CMS": "CMS", "BF": "BLOOM"}
ANSWERS = "qid long, result double, ci_low double, ci_high double"


def operator_spec(o) -> str:
    return f"{o.name}Operator{','.join(map(str, o.params))}"


def populate(spark: SparkSession, config: Config, folder: str) -> dict[str, Store]:
    """A store for each decay of an experiment; one that is there with all elements is left as it is."""
    stores, elements = {}, None
    for decay in config.decays:
        store = Store(spark, f"{folder.rstrip('/')}/{config.name()}/{decay}")
        for k in range(config.streams):
            store.register(k, decay, [operator_spec(o) for o in config.operators], config.buffer)
        if store.batch() < 0:
            elements = elements if elements is not None else config.elements(spark).persist()
            tag = config.data.get("tag-landmarks", {})
            marks = build.landmark_windows(elements, tag["threshold"]).select("stream_id", "ts", "te") if "threshold" in tag else None
            store.append(elements, marks, 0)
        stores[decay] = store
    if elements is not None:
        elements.unpersist()
    return stores


def run_workload(store: Store, queries: DataFrame, types: list[str], confidence: float = 0.95) -> DataFrame:
    """qid, result, ci_low, ci_high, seconds of typed queries (qid, stream_id, type, l, r, value).

    The queries of a type are one job, whose time is shared out evenly among them.
    Answers of yes or no are 1 and 0, and for certain where they are.
    """
    spark, out = queries.sparkSession, None
    for kind in types:
        mine = queries.filter(F.col("type") == kind)
        a = store.query(mine if KINDS[kind] in ("CMS", "BLOOM") else mine.drop("value"), KINDS[kind], confidence)
        if kind == "BF":
            a = a.select("qid", F.col("found").cast("double").alias("result"))
        elif kind == "MAX_THRESH":
            a = a.join(mine.select("qid", "value"), "qid").select("qid", F.coalesce((F.col("result") > F.col("value")).cast("double"), F.lit(0.0)).alias("result"))
        elif kind == "MAX":
            a = a.select("qid", F.col("result").cast("double").alias("result"))
        if "ci_low" not in a.columns:
            a = a.withColumn("ci_low", F.col("result")).withColumn("ci_high", F.col("result"))
        began = time.time()
        a = a.select("qid", *(F.col(c).cast("double") for c in ("result", "ci_low", "ci_high"))).persist()
        n = a.count()
        a = a.withColumn("seconds", F.lit((time.time() - began) / max(n, 1)))
        out = a if out is None else out.unionByName(a)
    return out if out is not None else spark.createDataFrame([], f"{ANSWERS}, seconds double")


def compare(stores: dict[str, Store], queries: DataFrame, elements: DataFrame, slice_width: int, types: list[str], confidence: float = 0.95) -> DataFrame:
    """A row for each decay, type, age and length class, in order of the decays' windows.

    decay, num_windows, num_elements, type, age_class, length_class, n, error_mean, error_p95, latency_p95, ci_width_p95,
    ci_miss_rate: the share of true answers outside of their intervals.
    """
    truth = workload.truth(queries, elements, slice_width).persist()
    out = None
    for decay, store in stores.items():
        size = store.window_counts().agg(F.sum("n_windows").alias("num_windows")).crossJoin(store.stats().agg(F.sum("n").alias("num_elements")))  # one row with one row
        told = run_workload(store, queries, types, confidence).join(truth, "qid").join(queries.select("qid", "type", "age_class", "length_class"), "qid")
        p = evaluate.error_profile(told, "type", "age_class", "length_class")
        late = told.groupBy("type", "age_class", "length_class").agg(F.percentile("seconds", 0.95).alias("latency_p95"))
        p = p.join(late, ["type", "age_class", "length_class"]).withColumn("decay", F.lit(decay)).join(F.broadcast(size))
        out = p if out is None else out.unionByName(p)
    columns = ("decay", "num_windows", "num_elements", "type", "age_class", "length_class", "n", "error_mean", "error_p95", "latency_p95", "ci_width_p95", "ci_miss_rate")
    return out.select(*columns).orderBy("num_windows", "decay", "type", "age_class", "length_class")


def run(spark: SparkSession, config: Config, folder: str) -> DataFrame:
    """The whole experiment of a configuration."""
    each = spark.range(config.streams).select(F.col("id").alias("stream_id"))
    queries = config.queries(spark).crossJoin(F.broadcast(each)).withColumn("qid", F.xxhash64("qid", "stream_id")).persist()  # streams of one experiment
    types = [o["type"].upper() for o in config.workload.get("operators", [])]
    t0, t1 = config.span
    return compare(populate(spark, config, folder), queries, config.elements(spark), max(1, (t1 - t0) // 1000), types)
