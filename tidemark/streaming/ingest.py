"""Continuous ingest: micro-batches of elements or operations go into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import build
from ..sources.store import Store, StreamError


def ingest(elements: DataFrame, store: Store, checkpoint: str, late: str = "drop", trigger: dict | None = None, aside: str | None = None) -> StreamingQuery:
    """Starts a query over a streaming frame of (stream_id, ts, value[, is_landmark]) or of operations (stream_id, op, ts, value).

    late: drop leaves out elements that are not later than their stream's last and adds
    their number to store.late(); error fails the query.  aside: a folder to which late
    elements go as Parquet, a folder for each batch.  trigger: as of writeStream, by
    default all that is there; {"processingTime": "10 seconds"} goes on for ever.
    How much a batch takes is set at the source (maxFilesPerTrigger and the like).
    The number of a batch is committed together with its elements, so a batch that comes
    again after a failure is added once.
    """
    operations = "op" in elements.columns

    def batch(frame: DataFrame, number: int) -> None:
        if store.batch() >= number:
            return
        last = store.table("sums").select("stream_id", "last_ts")
        rows = frame.filter("ts >= 0") if operations else build.checked(frame)
        told = rows.join(last, "stream_id", "left").withColumn("late", F.coalesce(F.col("ts") <= F.col("last_ts"), F.lit(False))).drop("last_ts")
        if operations:
            told = told.withColumn("late", F.col("late") & (F.col("op") == "APPEND"))
        told.persist()
        try:
            behind = told.filter("late").drop("late")
            n = behind.count()
            if n and late == "error":
                raise StreamError("times must strictly increase in a stream")
            if n and aside:
                behind.write.mode("overwrite").parquet(f"{aside.rstrip('/')}/batch={number}")
            good = told.filter("not late").drop("late")
            if operations:
                store.append_operations(good, number, n)
            else:
                store.append(good, None, number, n)
        finally:
            told.unpersist()

    return elements.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
