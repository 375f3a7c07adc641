"""Answers to a table of interval queries (qid, stream_id, l, r): an estimate and its confidence interval.

The two windows at the edges of a query count in proportion to the time that the
query covers of them, the ones between count whole, and landmark values are exact;
the time that landmarks take up is not part of a window's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell, cms_cell, normal_quantile
from .build import lookups, running, slice_at, slice_plan, sliced

END_OF_TIME = (1 << 62) - 1


def clamped(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """Adds t0, t1: the query's interval within the stream's; t0 > t1, or both null, where they are disjoint or the stream is unknown."""
    wrong = F.when((F.col("l") < 0) | (F.col("l") > F.col("r")), F.raise_error(F.lit("a query needs 0 <= l <= r")).cast("long"))
    return queries.join(stats, "stream_id", "left").withColumn("t0", F.coalesce(wrong, F.greatest("l", F.col("first_ts")) + F.col("first_ts") * 0)).withColumn("t1", F.least("r", "last_ts"))


def numbered_windows(windows: DataFrame) -> DataFrame:
    """Adds i, the place of each window in its stream; those with equal times by their counts."""
    order = [c for c in ("ts", "te", "cs") if c in windows.columns]
    return windows.withColumn("i", F.row_number().over(Window.partitionBy("stream_id").orderBy(*order)) - 1)


def window_points(windows: DataFrame, *carried: str) -> DataFrame:
    """Points of lookups(): ``after``, a window from where the one before it ends, and ``begun``, one from its start.  windows must have i."""
    order = Window.partitionBy("stream_id").orderBy("i")
    w = windows.withColumn("next_ts", F.lead("ts").over(order)).withColumn("from", F.coalesce(F.lag("te").over(order) + 1, F.lit(-(1 << 62))))
    p = F.struct("i", "ts", "te", "next_ts", *carried)
    none = F.when(F.lit(False), p)
    return w.select("stream_id", F.inline(F.array(F.struct(F.col("from").alias("at"), p.alias("after"), none.alias("begun")), F.struct(F.col("ts").alias("at"), none.alias("after"), p.alias("begun")))))


def located(asked: DataFrame, windows: DataFrame, *carried: str) -> DataFrame:
    """asked (qid, stream_id, t0, t1, ...) with a and b: the first and the last window that each touches, structs of i, ts, te, next_ts and the carried columns.

    A window that ends before t0, even if the next begins after t0, is not touched.
    Queries that touch no window have a null a and b.  Nothing grows with windows times queries.
    """
    q = lookups(asked, {"a": ("after", F.col("t0")), "b": ("begun", F.col("t1"))}, window_points(windows, *carried))
    some = F.coalesce((F.col("t0") <= F.col("t1")) & (F.col("a.i") <= F.col("b.i")) & (F.col("a.te") >= F.col("t0")), F.lit(False))
    return q.withColumn("some", some).withColumn("a", F.when(F.col("some"), F.col("a"))).withColumn("b", F.when(F.col("some"), F.col("b"))).drop("some")


def touched(asked: DataFrame, windows: DataFrame) -> DataFrame:
    """Each query with the windows that it touches, joined by their places."""
    w = numbered_windows(windows)
    spans = located(asked, w).filter("a is not null")
    each = spans.select(*asked.columns, F.explode(F.sequence(F.col("a.i"), F.col("b.i"))).alias("i"))
    return each.join(w, ["stream_id", "i"])


#: Windows that are merged beforehand for queries that touch all of them.
UNIT = 256


def merged(asked: DataFrame, windows: DataFrame, merges: dict[str, Callable], *keys: str) -> DataFrame:
    """Per query the merge of columns of all windows that it touches: name -> an aggregate that joins its own results.

    Whole units of UNIT windows are merged once for all queries; a query reads those
    and the single windows at its two ends.
    """
    w = numbered_windows(windows)
    single = w.select("stream_id", F.lit(0).alias("level"), F.col("i").alias("place"), *merges)
    units = w.groupBy("stream_id", F.floor(F.col("i") / UNIT).cast("int").alias("place")).agg(*(f(c).alias(c) for c, f in merges.items()))
    both = single.unionByName(units.select("stream_id", F.lit(1).alias("level"), "place", *merges))
    i, j = F.col("a.i"), F.col("b.i")
    low, high = F.ceil(i / UNIT).cast("int"), F.floor((j + 1) / UNIT).cast("int")  # whole units: low to high - 1
    run = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<int>"))
    ends = F.when(low < high, F.concat(run(i, low * UNIT - 1), run(high * UNIT, j))).otherwise(run(i, j))
    parts = F.concat(F.transform(ends, lambda x: F.struct(F.lit(0).alias("level"), x.alias("place"))), F.transform(run(low, high - 1), lambda x: F.struct(F.lit(1).alias("level"), x.alias("place"))))
    spans = located(asked, w).filter("a is not null").select("qid", "stream_id", F.inline(parts))
    return spans.join(both, ["stream_id", "level", "place"]).groupBy("qid").agg(*(f(c).alias(c) for c, f in merges.items()))


def united(landmarks: DataFrame) -> DataFrame:
    """Landmark windows (stream_id, ts, te) without overlaps; one that has not ended reaches to the end of time."""
    end = F.coalesce("te", F.lit(END_OF_TIME))
    order = Window.partitionBy("stream_id").orderBy("ts", "te")
    told = landmarks.select("stream_id", "ts", end.alias("te"))
    reach = F.max("te").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("new", F.coalesce(F.col("ts") > reach, F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(order))
    return told.groupBy("stream_id", "k").agg(F.min("ts").alias("ts"), F.max("te").alias("te")).drop("k")


def landmark_points(landmarks: DataFrame) -> DataFrame:
    """Points of lookups(): ``mark``, each landmark from its start, with the ticks of those before it."""
    m = united(landmarks)
    order = Window.partitionBy("stream_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("before", F.coalesce(F.sum(F.col("te") - F.col("ts") + 1).over(order), F.lit(0)))
    return m.select("stream_id", F.col("ts").alias("at"), F.struct("ts", "te", "before").alias("mark"))


def exact_values(asked: DataFrame, values: DataFrame) -> DataFrame:
    """Landmark values (stream_id, ts, ...) inside each query's interval: landmarks are few beside the elements."""
    v = values.withColumnRenamed("ts", "v_ts")
    return asked.filter("t0 <= t1").select("qid", "stream_id", "t0", "t1").join(v, "stream_id").filter("v_ts between t0 and t1")


def exact_merged(asked: DataFrame, values: DataFrame, made: dict[str, Column], merges: dict[str, Callable]) -> DataFrame:
    """qid and aggregates of the landmark values (stream_id, ts, ...) inside each query's interval, in several parts to be joined.

    made: name -> aggregate of values; merges: name -> one that joins its results.  A
    query takes whole slices of time, and single values only of the slices at its ends.
    """
    s, plan = sliced(values), slice_plan(values)
    q = asked.filter("t0 <= t1").join(plan, "stream_id", "left").select("qid", "stream_id", "t0", "t1", slice_at("t0").alias("a"), slice_at("t1").alias("b"))
    per = s.groupBy("stream_id", "slice").agg(*(c.alias(n) for n, c in made.items()))
    inside = q.filter("a + 1 < b").select("qid", "stream_id", (F.col("a") + 1).alias("t0"), (F.col("b") - 1).alias("t1"))
    inner = merged(inside, per.withColumn("ts", F.col("slice")).withColumnRenamed("slice", "te"), merges)
    ends = q.select("qid", "stream_id", "t0", "t1", F.explode(F.array_distinct(F.array("a", "b"))).alias("slice"))
    outer = ends.join(s, ["stream_id", "slice"]).filter("ts between t0 and t1").groupBy("qid").agg(*(c.alias(n) for n, c in made.items()))
    return inner.unionByName(outer)


def estimate(queries: DataFrame, windows: DataFrame, stats: DataFrame, measure: str, multiplier: Column, confidence: float = 0.95, landmarks: DataFrame | None = None, landmark_values: DataFrame | None = None) -> DataFrame:
    """qid, result, ci_low, ci_high; ci_low <= result <= ci_high.

    windows: stream_id, ts, te and the column ``measure``.  multiplier: the standard
    deviation of a unit of variance, from the columns of stats.  landmarks:
    (stream_id, ts, te); landmark_values: (stream_id, ts, s), s what a value adds.
    The ticks of landmarks are taken from an edge window's span, and from the part of
    it that the query covers: of each, those that lie in it.
    """
    asked = clamped(queries, stats).withColumn("k", multiplier).select("qid", "stream_id", "t0", "t1", "k")
    order = Window.partitionBy("stream_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    w = numbered_windows(windows.select("stream_id", "ts", "te", *(c for c in windows.columns if c == "cs"), F.col(measure).cast("double").alias("s"))).withColumn("run", F.sum("s").over(order))
    if landmark_values is not None:
        values = landmark_values.select("stream_id", "ts", F.col("s").cast("double").alias("sm"))
        q = running(located(asked, w, "s", "run"), {"e1": F.col("t1"), "e0": F.col("t0") - 1}, values, "sm")
        q = q.withColumn("sm", F.when(F.col("t0") <= F.col("t1"), F.coalesce("e1.sm", F.lit(0.0)) - F.coalesce("e0.sm", F.lit(0.0))))
    else:
        q = located(asked, w, "s", "run").withColumn("sm", F.lit(0.0))
    two = F.col("a.i") < F.col("b.i")
    q = q.withColumn("w", F.coalesce(F.col("b.i") - F.col("a.i") + 1, F.lit(0)))
    q = q.withColumn("l0", F.col("a.ts")).withColumn("l1", F.when(two, F.col("a.next_ts") - 1).otherwise(F.col("a.te")))
    q = q.withColumn("r0", F.when(two, F.col("b.ts"))).withColumn("r1", F.when(two, F.col("b.te")))
    q = q.withColumn("sl", F.col("a.s")).withColumn("sr", F.col("b.s")).withColumn("middle", F.when(F.col("w") > 2, F.col("b.run") - F.col("b.s") - F.col("a.run")).otherwise(0.0))
    spans = {"span_l": ("l0", "l1"), "span_r": ("r0", "r1"), "cover_l": (F.greatest("l0", "t0"), F.least("l1", "t1")), "cover_r": (F.greatest("r0", "t0"), F.least("r1", "t1"))}
    for name, (low, high) in spans.items():
        low, high = (F.col(x) if isinstance(x, str) else x for x in (low, high))
        side = F.col("r0" if name.endswith("r") else "l0").isNotNull()
        q = q.withColumn(f"{name}_0", F.when(side, low)).withColumn(f"{name}_1", F.when(side, F.greatest(high, low - 1)))
        q = q.withColumn(name, F.coalesce(F.col(f"{name}_1") - F.col(f"{name}_0") + 1, F.lit(0)))
    if landmarks is not None:
        edges = {f"{n}_{k}": ("mark", F.col(f"{n}_{k}") - (1 - k)) for n in spans for k in (0, 1)}
        keep = ["qid", "stream_id", "k", "w", "sl", "sr", "middle", "sm", *spans, *edges]
        q = lookups(q.select(*(F.col(c).alias(f"at_{c}") if c in edges else c for c in keep)), {e: (m, F.col(f"at_{e[:-2]}_{e[-1]}") - (1 - int(e[-1]))) for e, (m, _) in edges.items()}, landmark_points(landmarks))

        def upto(e: str) -> Column:
            return F.when(F.col(e).isNull(), F.lit(0)).otherwise(F.col(f"{e}.before") + F.least(F.col(f"at_{e}") - (1 - int(e[-1])), F.col(f"{e}.te")) - F.col(f"{e}.ts") + 1)

        q = q.select("*", *((upto(f"{n}_1") - upto(f"{n}_0")).alias(f"less_{n}") for n in spans))
    else:
        q = q.select("*", *(F.lit(0).cast("long").alias(f"less_{n}") for n in spans))
    return q.select("qid", *interval(confidence))


def interval(confidence: float) -> list[Column]:
    """result, ci_low, ci_high from the columns that estimate() gathers."""
    zero = F.lit(0.0)
    n0 = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("double")
    T1, p1 = n0("span_l") - n0("less_span_l"), n0("cover_l") - n0("less_cover_l")
    T2, p2 = n0("span_r") - n0("less_span_r"), n0("cover_r") - n0("less_cover_r")
    w = F.coalesce(F.col("w"), F.lit(0))
    sl, sr = F.when(w > 0, F.col("sl")).otherwise(zero), F.when(w > 1, F.col("sr")).otherwise(zero)  # of one window, sl is all
    exact = n0("sm") + F.coalesce(F.col("middle"), zero)
    share = lambda s, t, T: F.when(T > 0, s * t / T).otherwise(zero)
    spread = lambda s, t, T: F.when(T > 0, F.abs(s) * (t / T) * (1 - t / T)).otherwise(zero)
    mean = exact + share(sl, p1, T1) + F.when(w > 1, share(sr, p2, T2)).otherwise(zero)
    var = spread(sl, p1, T1) + F.when(w > 1, spread(sr, p2, T2)).otherwise(zero)
    whole = lambda s, t, T: F.when(t == T, s).otherwise(zero)
    part = lambda s, t, f: f(s, whole(s, t[0], t[1]))
    # What an edge window adds lies between nothing (all of it, if it is covered whole) and all of it, whatever the sign of its sum.
    low = exact + part(sl, (p1, T1), F.least) + F.when(w > 1, part(sr, (p2, T2), F.least)).otherwise(zero)
    high = exact + part(sl, (p1, T1), F.greatest) + F.when(w > 1, part(sr, (p2, T2), F.greatest)).otherwise(zero)
    z = normal_quantile(confidence)
    if z is None:
        return [mean.alias("result"), F.least(low, mean).alias("ci_low"), F.greatest(high, mean).alias("ci_high")]
    half = F.lit(z) * F.coalesce(F.col("k"), zero) * F.sqrt(F.greatest(var, zero))
    return [mean.alias("result"), F.least(F.greatest(mean - half, low), mean).alias("ci_low"), F.greatest(F.least(mean + half, high), mean).alias("ci_high")]


def mean(counts: DataFrame, sums: DataFrame) -> DataFrame:
    """qid, result (null of nothing), ci_low, ci_high of the mean, from estimates of the count and the sum."""
    c = counts.select("qid", *(F.col(x).alias(f"n_{x}") for x in ("result", "ci_low", "ci_high")))
    ratio = lambda top, bottom: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))
    corners = [ratio(f"ci_{x}", f"n_ci_{y}") for x in ("low", "high") for y in ("low", "high")]
    told = sums.join(c, "qid").withColumn("mean", ratio("result", "n_result"))
    return told.select("qid", F.col("mean").alias("result"), F.least("mean", *corners).alias("ci_low"), F.greatest("mean", *corners).alias("ci_high"))


def count_multiplier() -> Column:
    return F.col("gap_cv")


def sum_multiplier() -> Column:
    return F.sqrt(F.greatest((F.col("gap_cv") ** 2 + F.col("value_cv") ** 2) * F.col("value_mean"), F.lit(0.0)))


def interval_max(queries: DataFrame, windows: DataFrame, stats: DataFrame, landmark_values: DataFrame | None = None) -> DataFrame:
    """qid, result (null: nothing there), certain: whether no summary took part.  A window counts whole, so it is an upper bound."""
    asked = clamped(queries, stats)
    parts = merged(asked, windows.select("stream_id", "ts", "te", "max"), {"max": F.max}).select("qid", F.col("max").alias("v"), F.col("max").isNotNull().alias("s"))
    if landmark_values is not None:
        kept = exact_merged(asked, landmark_values.select("stream_id", "ts", "value"), {"max": F.max("value")}, {"max": F.max})
        parts = parts.unionByName(kept.select("qid", F.col("max").alias("v"), F.lit(False).alias("s")))
    found = parts.groupBy("qid").agg(F.max("v").alias("result"), (~F.max("s")).alias("certain"))
    return queries.select("qid").join(found, "qid", "left").select("qid", "result", F.coalesce("certain", F.lit(True)).alias("certain"))


def frequency(queries: DataFrame, windows: DataFrame, cells: DataFrame, stats: DataFrame, depth: int, width: int, confidence: float = 0.95, landmarks: DataFrame | None = None, landmark_values: DataFrame | None = None) -> DataFrame:
    """Estimated occurrences of the query's ``value``: the least cell of each window is its measure.

    Each (stream, value) asked for is a stream of its own to the estimator.
    """
    values = queries.select("stream_id", "value").distinct()
    wanted = values.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("col", cms_cell(F.col("value"), F.col("row"), width))
    found = wanted.join(cells, ["stream_id", "row", "col"]).groupBy("stream_id", "value", "cs").agg(F.min("n").alias("low"), F.count("*").alias("rows"))
    key = F.concat_ws(":", "stream_id", "value").alias("stream_id")
    per = lambda frame, *columns: frame.join(values, "stream_id").select(key, *columns)
    mine = windows.select("stream_id", "cs", "ts", "te").join(values, "stream_id").join(found.filter(F.col("rows") == depth), ["stream_id", "value", "cs"], "left").select(key, "cs", "ts", "te", F.coalesce("low", F.lit(0)).alias("f"))
    exact = None if landmark_values is None else landmark_values.join(values, ["stream_id", "value"]).select(key, "ts", F.lit(1).alias("s"))
    names = [c for c in stats.columns if c != "stream_id"]
    return estimate(queries.select("qid", key, "l", "r"), mine, per(stats, *names), "f", count_multiplier(), confidence, None if landmarks is None else per(landmarks, "ts", "te"), exact)


def membership(queries: DataFrame, windows: DataFrame, bits: DataFrame, stats: DataFrame, hashes: int, size: int, landmark_values: DataFrame | None = None) -> DataFrame:
    """qid, found, error: whether the query's ``value`` is a landmark's value in the interval, or some touched window's Bloom filter holds it.

    error is the chance that the answer is wrong: none for an absent value and for a
    landmark's; else that it lies in a touched window outside of the query's interval,
    or that the filter, taken to err once in a hundred, is wrong.
    """
    clear = clamped(queries, stats)
    spans = located(clear, numbered_windows(windows.select("stream_id", "cs", "ts", "te")), "cs").filter("a is not null")
    asked = touched(clear, windows.select("stream_id", "cs", "ts", "te")).select("qid", "stream_id", "cs", "value", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("k"))
    pos = asked.withColumn("pos", cell(F.col("value"), F.col("k"), size)).withColumn("bucket", F.bitmap_bucket_number("pos")).withColumn("bit", F.bitmap_bit_position("pos"))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = F.floor(byte / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1
    has = pos.join(bits, ["stream_id", "cs", "bucket"], "left").withColumn("has", F.coalesce(set_, F.lit(False)))
    each = has.groupBy("qid", "cs").agg(F.min("has").alias("all")).groupBy("qid").agg(F.max("all").alias("seen"))
    share = F.col("t1") - F.col("t0") + 1
    chance = spans.select("qid", (1 - 0.99 * F.least(share / (F.col("b.te") - F.col("a.ts") + 1), F.lit(1.0))).alias("chance"))
    told = queries.select("qid").join(each, "qid", "left").join(chance, "qid", "left")
    if landmark_values is not None:
        v = exact_values(clear, landmark_values.select("stream_id", "ts", F.col("value").alias("v"))).join(clear.select("qid", "value"), "qid").filter("v = value").select("qid", F.lit(True).alias("kept")).distinct()
        told = told.join(v, "qid", "left")
    else:
        told = told.withColumn("kept", F.lit(None).cast("boolean"))
    exact, seen = F.coalesce("kept", F.lit(False)), F.coalesce("seen", F.lit(False))
    return told.select("qid", (exact | seen).alias("found"), F.when(~exact & seen, F.col("chance")).otherwise(0.0).alias("error"))


def distinct_count(queries: DataFrame, windows: DataFrame, stats: DataFrame, landmark_values: DataFrame | None = None) -> DataFrame:
    """Distinct values of the touched windows and of landmarks in the interval, the sketches united before the estimate."""
    asked = clamped(queries, stats)
    parts = merged(asked, windows.select("stream_id", "ts", "te", "hll"), {"hll": F.hll_union_agg})
    if landmark_values is not None:
        parts = parts.unionByName(exact_merged(asked, landmark_values.select("stream_id", "ts", "value"), {"hll": F.hll_sketch_agg("value", 12)}, {"hll": F.hll_union_agg}))
    found = parts.groupBy("qid").agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("result"))
    return queries.select("qid").join(found, "qid", "left").fillna(0, ["result"])


def quantile(queries: DataFrame, windows: DataFrame, stats: DataFrame, q: float, landmark_values: DataFrame | None = None) -> DataFrame:
    """The q-quantile of the values of touched windows and of landmarks in the interval (null: nothing there)."""
    asked = clamped(queries, stats)
    parts = merged(asked, windows.select("stream_id", "ts", "te", "kll"), {"kll": F.kll_merge_agg_bigint})
    if landmark_values is not None:
        parts = parts.unionByName(exact_merged(asked, landmark_values.select("stream_id", "ts", "value"), {"kll": F.kll_sketch_agg_bigint("value")}, {"kll": F.kll_merge_agg_bigint}))
    one = parts.groupBy("qid").agg(F.kll_merge_agg_bigint("kll").alias("kll")).filter(F.kll_sketch_get_n_bigint("kll") > 0)
    found = one.select("qid", F.kll_sketch_get_quantile_bigint("kll", F.lit(q)).alias("result"))
    return queries.select("qid").join(found, "qid", "left")


def range_frequency(queries: DataFrame, windows: DataFrame, stats: DataFrame, low: int, high: int, confidence: float = 0.95, landmarks: DataFrame | None = None, landmark_values: DataFrame | None = None) -> DataFrame:
    """Estimated number of values in [low, high]: from the quantile sketches of windows, exactly of landmarks."""
    exact = None if landmark_values is None else landmark_values.filter(F.col("value").between(low, high)).select("stream_id", "ts", F.lit(1).alias("s"))
    return estimate(queries, with_range_counts(windows, low, high), stats, "in_range", count_multiplier(), confidence, landmarks, exact)


def with_range_counts(windows: DataFrame, low: int, high: int) -> DataFrame:
    """Adds in_range: each window's estimated number of values in [low, high], a measure for estimate()."""
    rank = lambda v: F.kll_sketch_get_rank_bigint("kll", F.lit(v).cast("long"))
    return windows.withColumn("in_range", F.when(F.col("count") > 0, F.round((rank(high) - rank(low - 1)) * F.col("count"))).otherwise(0).cast("long"))
