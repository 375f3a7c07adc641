"""Element sources: (stream_id, ts, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import SAMPLERS
from ..operators.build import sliced


def ticks(ts: Column) -> Column:
    """Microseconds of a wall-clock time, whatever the session's time zone."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def events(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """The events table; times in microseconds, values in hundredths.  key: an expression for the stream, else there is one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.expr(key or "0").cast("long").alias("stream_id"), ticks(F.col("ts")).alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"))


def without_repeats(elements: DataFrame) -> DataFrame:
    """Of elements of a stream at the same time, the one with the smallest value."""
    return elements.groupBy("stream_id", "ts").agg(F.min("value").alias("value"))


def from_operations(operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements (stream_id, ts, value, is_landmark) and landmark windows (stream_id, ts, te) of a stream of operations.

    operations: (stream_id, op, ts, value) with op APPEND, LANDMARK_START or
    LANDMARK_END.  At one time a start comes before the append and an end after it.
    A start within a landmark and an end outside of one change nothing; a landmark
    that has not ended has a null te.  Other values of op raise.  Where there is a
    column seq, it orders what happens at one time instead.
    """
    place = F.when(F.col("op") == "LANDMARK_START", 0).when(F.col("op") == "APPEND", 1).when(F.col("op") == "LANDMARK_END", 2)
    place = F.coalesce(place, F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))).cast("int"))
    told = sliced(operations.withColumn("place", place).withColumn("seq", F.col("seq") if "seq" in operations.columns else F.col("place"))).withColumn("opens", F.when(F.col("place") != 1, F.col("place") == 0))
    marks = told.filter("opens is not null")
    last = told.groupBy("stream_id", "slice").agg(F.max_by("opens", F.when(F.col("opens").isNotNull(), F.struct("ts", "seq"))).alias("opens"))
    earlier = Window.partitionBy("stream_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("stream_id", "slice", F.last("opens", True).over(earlier).alias("before"))
    own = Window.partitionBy("stream_id", "slice").orderBy("ts", "seq")
    state = F.coalesce(F.last("opens", True).over(own), F.col("before"), F.lit(False))
    elements = told.join(carried, ["stream_id", "slice"]).withColumn("is_landmark", state).filter("place = 1").select("stream_id", "ts", "value", "is_landmark")
    by_time = Window.partitionBy("stream_id").orderBy("ts", "seq")  # marks alone, which are few beside the elements
    turns = marks.withColumn("was", F.coalesce(F.lag("opens").over(by_time), F.lit(False))).filter("opens != was")
    windows = turns.withColumn("te", F.lead("ts").over(by_time)).filter("opens").select("stream_id", "ts", "te")
    return elements, windows


def to_operations(elements: DataFrame, landmarks: DataFrame, marked: bool = False) -> DataFrame:
    """The stream of operations that from_operations() reads: appends, and the edges of landmark windows.

    marked: elements have a true is_landmark where they are in landmarks, and a column
    seq keeps them apart from normal elements at the same time.
    """
    none = F.lit(None).cast("long").alias("value")
    edge = lambda op, at, seq: landmarks.filter(F.col(at).isNotNull()).select("stream_id", F.lit(op).alias("op"), F.col(at).alias("ts"), none, F.lit(seq).alias("seq"))
    seq = F.when(F.col("is_landmark"), 2).otherwise(0) if marked else F.lit(2)
    every = elements.select("stream_id", F.lit("APPEND").alias("op"), "ts", "value", seq.alias("seq")).unionByName(edge("LANDMARK_START", "ts", 1)).unionByName(edge("LANDMARK_END", "te", 3))
    return every if marked else every.drop("seq")


def csv(spark: SparkSession, path: str, stream_id: int = 0, t0: int = 0, t1: int = (1 << 62)) -> DataFrame:
    """Lines ``ts,value``; blank lines and those with # are skipped, as are repeated times and what lies outside of [t0, t1]."""
    raw = spark.read.csv(path, schema="ts long, value long", comment="#")
    return without_repeats(raw.filter(F.col("ts").between(t0, t1)).select(F.lit(stream_id).cast("long").alias("stream_id"), "ts", "value"))


def trace(spark: SparkSession, path: str, frequencies: bool = False) -> DataFrame:
    """Lines ``ts,node,bytes``; a node is a stream and bytes its values.

    frequencies: one stream whose values are nodes, each with its bytes as weight, for
    frequencies of nodes; weights and plain values do not mix in one stream.
    """
    raw = spark.read.csv(path, schema="ts long, node long, bytes long", comment="#")
    if frequencies:
        return raw.select(F.lit(0).cast("long").alias("stream_id"), "ts", F.col("node").alias("value"), F.col("bytes").alias("weight"))
    return raw.select(F.col("node").alias("stream_id"), "ts", F.col("bytes").alias("value"))


def repeated(elements: DataFrame, times: int, gap: int) -> DataFrame:
    """Copies of each stream one after another, each shifted by the last time and a gap."""
    last = elements.groupBy("stream_id").agg((F.max("ts") + gap).alias("shift"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")))
    return elements.join(last, "stream_id").withColumn("copy", copies).select("stream_id", (F.col("ts") + F.col("copy") * F.col("shift")).alias("ts"), "value")


def synthetic(spark: SparkSession, n: int, gaps: tuple, values: tuple, t0: int = 0, seed: int = 1, streams: int = 1, slices: int = 64) -> DataFrame:
    """n elements of each stream with random gaps and values: (sampler, parameters...) each.

    Randomness is a hash of the element's number, so a task that runs again draws
    the same.  Running sums are taken in slices, which are then shifted.
    """
    u = lambda k: (F.pmod(F.xxhash64("stream_id", "i", F.lit(seed + k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    base = spark.range(n * streams).select((F.col("id") % streams).alias("stream_id"), F.floor(F.col("id") / streams).alias("i"))
    drawn = base.withColumn("gap", SAMPLERS[gaps[0]](u(0), *gaps[1:])).withColumn("value", SAMPLERS[values[0]](u(7), *values[1:])).withColumn("slice", F.floor(F.col("i") * slices / n))
    total = drawn.groupBy("stream_id", "slice").agg(F.sum("gap").alias("g"))
    shift = total.select("stream_id", "slice", F.coalesce(F.sum("g").over(Window.partitionBy("stream_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    run = F.sum("gap").over(Window.partitionBy("stream_id", "slice").orderBy("i"))
    own = drawn.withColumn("run", run).join(shift, ["stream_id", "slice"])
    return own.select("stream_id", (F.lit(t0) + F.col("shift") + F.col("run")).alias("ts"), "value")
