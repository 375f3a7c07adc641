"""Query workloads and their exact answers."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import SAMPLERS
from . import estimator
from .build import lookups

#: Names of the calendar's bins, their unit in seconds, and the first and last multiple in each: fixed values.
CALENDAR = (
    ("subsecond", 1, 0, 0), ("seconds", 1, 1, 59), ("minutes", 60, 1, 59), ("hours", 3600, 1, 23), ("days", 86400, 1, 29), ("months", 2592000, 1, 11),
    ("years", 31536000, 1, 9), ("decades", 315532800, 1, 9), ("centuries", 3155760000, 1, 9),
)
YEAR = 31536000


def calendar_bins(spark: SparkSession, smallest: str = "subsecond") -> DataFrame:
    """(bin, place, unit, multiple); the smallest bin is age 0, which is no length."""
    rows = [(name, i, unit, k) for i, (name, unit, low, high) in enumerate(CALENDAR) for k in range(low, high + 1)]
    first = [x[0] for x in CALENDAR].index(smallest)
    return spark.createDataFrame([r for r in rows if r[1] >= first], "bin string, place int, unit long, multiple long")


def age_length_pairs(bins: DataFrame, most: int) -> DataFrame:
    """(age_class, length_class, age, length) of all that lie in ``most`` seconds."""
    ages = bins.select(F.col("bin").alias("age_class"), (F.col("unit") * F.col("multiple")).alias("age"))
    lengths = bins.select(F.col("bin").alias("length_class"), (F.col("unit") * F.col("multiple")).alias("length")).filter("length > 0")
    return ages.join(F.broadcast(lengths), F.col("age") + F.col("length") - 1 <= most)  # a few hundred fixed rows


def calendar_workload(bins: DataFrame, t0: int, t1: int, ticks: int) -> DataFrame:
    """Every age with every length that lies in [t0, t1]: r = t1 - age * ticks, l = r - length * ticks + ticks."""
    pairs = age_length_pairs(bins, (t1 - t0) // ticks + 1)
    r = F.lit(t1) - F.col("age") * ticks
    return pairs.select("age_class", "length_class", "age", "length", (r - F.col("length") * ticks + ticks).alias("l"), r.alias("r")).filter(F.col("l") >= t0)


def rescaled_workload(bins: DataFrame, t0: int, t1: int) -> DataFrame:
    """The calendar of one year, drawn out or pressed together to [t0, t1]."""
    scale = (t1 - t0) / YEAR
    r = F.lit(YEAR) - F.col("age")
    at = lambda x: (F.lit(t0) + F.floor(x * scale)).cast("long")
    pairs = age_length_pairs(bins, YEAR)
    return pairs.select("age_class", "length_class", "age", "length", at(r - F.col("length") + 1).alias("l"), at(r).alias("r"))


def typed(workload: DataFrame, operators: list[dict], seed: int = 0) -> DataFrame:
    """Every query for each of several operators ({"type": ..., "param": (sampler, parameters...) or {"threshold": n}}).

    Adds type, and value: what BF and CMS ask for, drawn by a hash of the query, or the
    threshold of MAX_THRESH; qid numbers the queries by a hash of their place.
    """
    out = None
    for k, o in enumerate(operators):
        kind, param = o["type"].upper(), o.get("param")
        u = (F.pmod(F.xxhash64("age", "length", F.lit(seed + k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        value = F.lit(param["threshold"]) if isinstance(param, dict) else SAMPLERS[param[0]](u, *param[1:]) if param else F.lit(None)
        mine = workload.withColumn("type", F.lit(kind)).withColumn("value", value.cast("long")).withColumn("operator", F.lit(k))
        out = mine if out is None else out.unionByName(mine)
    return out.withColumn("qid", F.xxhash64("type", "operator", "age", "length"))


def shuffled(workload: DataFrame, seed: int = 0) -> DataFrame:
    """The queries in random order, the same for the same seed."""
    return workload.orderBy(F.xxhash64(*workload.columns, F.lit(seed)), *workload.columns)


def sampled(workload: DataFrame, per_class: int, seed: int = 0) -> DataFrame:
    """So many queries of each class, chosen by a hash of their places: a sampling operator."""
    order = Window.partitionBy("age_class", "length_class").orderBy(F.xxhash64("age", "length", F.lit(seed)), "age", "length")
    return workload.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_class).drop("k")


def logarithmic_classes(most_age: int, n_age: int, most_length: int, n_length: int) -> tuple[list[int], list[int]]:
    """Markers 2^(i log2 A / n) of ages and 2^(2^(i log2 log2 L / n)) of lengths, rounded up; the first is 1 and the last beyond the stream."""
    ages = [1, *(math.ceil(2 ** (i * math.log2(most_age) / n_age)) for i in range(1, n_age)), most_age + 1]
    return ages, [1, *(math.ceil(2 ** (2 ** (i * math.log2(math.log2(most_length)) / n_length))) for i in range(1, n_length)), most_length + 1]


def read_weights(text: str) -> tuple[int, int, list[float]]:
    """Numbers of age and length classes, then a weight for each pair of them, by age; other words are left out."""
    found = re.findall(r"(?<![\w.])-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.])", text)
    n_age, n_length = int(found[0]), int(found[1])
    weights = [float(x) for x in found[2:]]
    if len(weights) != n_age * n_length:
        raise ValueError(f"{n_age} by {n_length} classes need as many weights, not {len(weights)}")
    return n_age, n_length, weights


def logarithmic_workload(spark: SparkSession, t0: int, t1: int, n_age: int, n_length: int, weights: list[float], queries: int, seed: int = 0, tries: int = 64) -> DataFrame:
    """So many queries: a class by its weight, an age and a length in it at random, drawn again where they leave the stream."""
    span = t1 - t0 + 1
    ages, lengths = logarithmic_classes(span, n_age, span, n_length)
    total, run, rows = sum(weights), 0.0, []
    for k, w in enumerate(weights):
        a, b = divmod(k, n_length)
        rows.append((f"a{a}", f"l{b}", run / total, (run + w) / total, ages[a], ages[a + 1] - 1, lengths[b], lengths[b + 1] - 1))
        run += w
    classes = spark.createDataFrame(rows, "age_class string, length_class string, low double, high double, a0 long, a1 long, b0 long, b1 long")
    u = lambda k: (F.pmod(F.xxhash64("qid", "try", F.lit(seed + k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    drawn = spark.range(queries).withColumnRenamed("id", "qid").withColumn("try", F.lit(0)).withColumn("u", u(0)).join(F.broadcast(classes), F.col("u").between(F.col("low"), F.col("high")) & (F.col("u") > F.col("low")))
    each = drawn.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    place = lambda v, low, high: (F.col(low) + F.floor(v * (F.col(high) - F.col(low) + 1))).cast("long")
    each = each.withColumn("age", F.least(place(u(1), "a0", "a1"), "a1")).withColumn("length", F.least(place(u(2), "b0", "b1"), "b1")).filter(F.col("age") + F.col("length") - 1 <= span - 1)
    first = each.groupBy("qid").agg(F.min_by(F.struct("age_class", "length_class", "age", "length"), "try").alias("x")).select("qid", "x.*")
    return first.withColumn("r", F.lit(t1) - F.col("age")).withColumn("l", F.col("r") - F.col("length") + 1).select("qid", "age_class", "length_class", "age", "length", "l", "r")


def fixed_bins(spark: SparkSession, t0: int, t1: int, width: int) -> DataFrame:
    """Backwards bins of equal width: [t1 - (k + 1) width + 1, t1 - k width] while they begin at t0 or later."""
    n = (t1 - t0 + 1) // width
    return spark.range(n).select(F.col("id").alias("qid"), (t1 - (F.col("id") + 1) * width + 1).alias("l"), (t1 - F.col("id") * width).alias("r"))


def forward_bins(spark: SparkSession, t0: int, t1: int, ticks: int) -> DataFrame:
    """[t, t + ticks] for each step of ticks from t0 on that ends by t1."""
    n = max(0, (t1 - t0) // ticks)
    return spark.range(n).select(F.col("id").alias("qid"), (t0 + F.col("id") * ticks).alias("l"), (t0 + (F.col("id") + 1) * ticks).alias("r"))


def fixed_length_workload(workload: DataFrame, seconds: int) -> DataFrame:
    """The queries of one length, at every age."""
    return workload.filter(F.col("length") == seconds)


def frequency_workload(workload: DataFrame, values: DataFrame, n: int, step: int) -> DataFrame:
    """Every query for each of n values of falling popularity: of (value), those of ranks 1, 1 + step, 1 + 2 step and so on.

    Values are counted before they are ranked, and n rows, no more, come to the driver.
    """
    top = values.groupBy("value").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "value").limit((n - 1) * step + 1)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("k"), "value"))).filter((F.col("rank") - 1) % step == 0).collect()
    each = F.array(*(F.struct(F.lit(r["rank"]).alias("rank"), F.lit(r["value"]).cast("long").alias("value")) for r in ranked))
    return workload.select("*", F.inline(each)) if ranked else workload.selectExpr("*", "0 as rank", "0L as value").limit(0)


def true_answers(queries: DataFrame, elements: DataFrame, slice_width: int) -> DataFrame:
    """Exact count, sum and max of each interval (qid, stream_id, l, r).

    Elements are first summed in slices of time, and slices in units; an interval takes
    whole units and slices, and single elements only of the slices at its edges, so
    nothing grows with elements times queries.
    """
    s = elements.withColumn("slice", F.floor(F.col("ts") / slice_width))
    per = s.groupBy("stream_id", "slice").agg(F.count("*").alias("k"), F.sum("value").alias("v"), F.max("value").alias("m"))
    q = queries.select("qid", "stream_id", "l", "r").withColumn("a", F.floor(F.col("l") / slice_width)).withColumn("b", F.floor(F.col("r") / slice_width))
    inside = q.filter("a + 1 < b").select("qid", "stream_id", (F.col("a") + 1).alias("t0"), (F.col("b") - 1).alias("t1"))
    windows = per.select("stream_id", F.col("slice").alias("ts"), F.col("slice").alias("te"), "k", "v", "m")
    inner = estimator.merged(inside, windows, {"k": F.sum, "v": F.sum, "m": F.max})
    edge = q.select("qid", "stream_id", "l", "r", F.explode(F.array_distinct(F.array("a", "b"))).alias("slice"))
    outer = edge.join(s.select("stream_id", "slice", "ts", "value"), ["stream_id", "slice"]).filter("ts between l and r").groupBy("qid").agg(F.count("*").alias("k"), F.sum("value").alias("v"), F.max("value").alias("m"))
    told = inner.unionByName(outer).groupBy("qid").agg(F.sum("k").alias("true_count"), F.sum("v").alias("true_sum"), F.max("m").alias("true_max"))
    return queries.join(told, "qid", "left").fillna(0, ["true_count", "true_sum"])


def true_values(queries: DataFrame, elements: DataFrame) -> DataFrame:
    """qid, truth: how often each query's ``value`` occurs in its interval.  Occurrences of a value are looked up by their running number."""
    values = queries.select("stream_id", "value").distinct()
    key = F.concat_ws(":", "stream_id", "value").alias("stream_id")
    order = Window.partitionBy("stream_id", "value").orderBy("ts")
    points = elements.join(values, ["stream_id", "value"]).select(key, F.col("ts").alias("at"), F.struct(F.row_number().over(order).alias("k")).alias("p"))
    asks = queries.select(key, "qid", "l", "r")
    found = lookups(asks, {"b": ("p", F.col("r")), "a": ("p", F.col("l") - 1)}, points)
    return found.select("qid", (F.coalesce("b.k", F.lit(0)) - F.coalesce("a.k", F.lit(0))).alias("truth"))


def truth(queries: DataFrame, elements: DataFrame, slice_width: int) -> DataFrame:
    """qid, truth of typed queries: COUNT, SUM, MEAN, MAX, MAX_THRESH and BF (1 or 0), CMS."""
    kind = F.col("type")
    plain = true_answers(queries.filter(~kind.isin("BF", "CMS")), elements, slice_width)
    mean = F.when(F.col("true_count") > 0, F.col("true_sum") / F.col("true_count"))
    value = F.when(kind == "COUNT", F.col("true_count")).when(kind == "SUM", F.col("true_sum")).when(kind == "MEAN", mean).when(kind == "MAX", F.col("true_max")).otherwise((F.col("true_max") > F.col("value")).cast("double"))
    asked = queries.filter(kind.isin("BF", "CMS"))
    seen = asked.select("qid", "type").join(true_values(asked, elements), "qid").select("qid", F.when(F.col("type") == "BF", (F.col("truth") > 0).cast("double")).otherwise(F.col("truth").cast("double")).alias("truth"))
    return plain.select("qid", value.cast("double").alias("truth")).unionByName(seen)


DAY = 86400
#: Shapes of the backup trace's queries: days from the first to the last, whether they end at the newest time, what is asked, and whether by node: fixed values.
SHAPES = {1: (7, True, "sum", False), 2: (30, False, "sum", False), 3: (7, True, "sum", True), 4: (1, False, "sum", True), 5: (1, False, "enum", False), 6: (1, True, "sum", False), 7: (1, False, "sum", False), 27: (1, False, "count", False)}


def backup_shapes(elements: DataFrame, now: int, start: int, ticks: int, shapes: tuple[int, ...] = tuple(SHAPES)) -> DataFrame:
    """(shape, node, ts, value): the answers, over nodes as streams, of each shape; enum gives every element."""
    out = None
    for k in shapes:
        days, newest, what, by_node = SHAPES[k]
        low = now - days * DAY * ticks if newest else start
        mine = elements.filter((F.col("ts") >= low) & (F.col("ts") <= (now if newest else low + days * DAY * ticks)))
        none = F.lit(None).cast("long")
        if what == "enum":
            mine = mine.select(F.lit(k).alias("shape"), F.col("stream_id").alias("node"), "ts", "value")
        else:
            total = (F.sum("value") if what == "sum" else F.count("*")).cast("long").alias("value")
            mine = mine.groupBy(*([F.col("stream_id").alias("node")] if by_node else [])).agg(total)
            mine = mine.select(F.lit(k).alias("shape"), (F.col("node") if by_node else none).alias("node"), none.alias("ts"), "value")
        out = mine if out is None else out.unionByName(mine)
    return out
