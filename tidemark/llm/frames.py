"""What every operator needs of its input tables and of the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one that the session names in spark.checkpoint.dir.  Only a local
    session, as in tests, may leave it unset; then a folder of the warehouse is taken.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def materialise(frame: DataFrame, label: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: it cuts the lineage, and a lost executor costs nothing."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def one_row_per_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows that have no id; of rows that share one, the one that texts_by_id() takes the text of, ties by a hash of all columns."""
    some = docs.filter(F.col(id_col).isNotNull())
    if not some.groupBy(id_col).count().filter("count > 1").limit(1).count():
        return some
    order = F.struct(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.xxhash64(*docs.columns))
    return some.groupBy(F.col(id_col).alias("_id")).agg(F.min_by(F.struct(*docs.columns), order).alias("_row")).select("_row.*")


def discard(frame: DataFrame) -> None:
    """Deletes what materialise() wrote for a frame that is not needed any more."""
    spark = frame.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def texts_by_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with unique, non-null ids.

    A null text is empty.  Rows without an id are left out.  Rows that share an
    id are one document: the smallest of their texts.  The ids are looked at
    first (a scan of one column), so that only tables with repeated ids pay for that.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    odd = base.groupBy("doc_id").count().filter("doc_id is null or count > 1").limit(1).count()
    return base.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text")) if odd else base


def with_totals(frame: DataFrame, keys: list[str], spread: str, **totals: tuple) -> DataFrame:
    """Adds totals over the rows of equal keys: name=(column, function), the function one that joins its own results, as sum, min and max.

    Rows of a key are dealt out by the column ``spread`` as well, so one key with a
    third of all rows is not one task: its parts are totalled, then the totals of
    the parts, one row for each, and each part gets the whole total.
    """
    told = frame.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(shuffle_partitions(frame.sparkSession))))
    parts = told.groupBy(*keys, "_part").agg(*(f(c).alias(name) for name, (c, f) in totals.items()))
    whole = parts.groupBy(*keys).agg(*(f(name).alias(name) for name, (_, f) in totals.items()), F.collect_list("_part").alias("_parts"))
    return told.join(whole.withColumn("_part", F.explode("_parts")).drop("_parts"), [*keys, "_part"]).drop("_part")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
