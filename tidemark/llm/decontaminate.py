"""Operator 7: benchmark items inside documents, in Spark functions only.

An item is held to be in a document when at least ``percent`` of its distinct
``n``-word shingles are in it.  Items are partitioned by size (powers of two).  The
signature of an item is its bottom-k MinHash, the k shingles with the least
hashes; k is, for the largest size of a partition, the number that must meet any
set that contains ``percent`` of the item, so no contained item is missed.  A
document that holds a signature shingle is a candidate, and is compared with the
item's shingles as strings.

The documents are read twice: once to look up hashes, once for the candidates.
Signatures are broadcast up to BROADCAST_ROWS, items' shingles up to BROADCAST_BYTES
(an item can be a book), and joined by a shuffle beyond.

Edge cases: null texts are empty; an item or document without words matches
nothing; one with fewer words than ``n`` has one shingle of all of them; rows with
null ids are left out; rows that share an id are one text, the smallest; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import materialise, texts_by_id
from .native import word_list

WORDS, PERCENT = 5, 75
#: Rows of 16 bytes: signature shingles, or candidate ids.
BROADCAST_ROWS = 500_000
#: Bytes of the items' shingles.
BROADCAST_BYTES = 32 << 20


def _places(words: Column, n: int) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, n: int) -> Column:
    return F.array_distinct(F.transform(_places(words, n), lambda i: F.xxhash64(F.slice(words, i, n))))


def _strings(words: Column, n: int) -> Column:
    return F.array_distinct(F.transform(_places(words, n), lambda i: F.array_join(F.slice(words, i, n), " ")))


def _few(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _light(frame: DataFrame, column: str) -> DataFrame:
    size = frame.agg(F.sum(F.aggregate(column, F.lit(64).cast("long"), lambda n, x: n + F.octet_length(x) + 32))).first()[0]
    return F.broadcast(frame) if (size or 0) <= BROADCAST_BYTES else frame


def signatures(items: DataFrame, n: int, percent: int) -> DataFrame:
    """(token, item_id): items has item_id and hashes."""
    sized = items.withColumn("n_item", F.size("hashes")).filter("n_item > 0").withColumn("part", F.floor(F.log2("n_item")))
    most = sized.groupBy("part").agg(F.max("n_item").alias("most"))
    k = F.expr(f"most - (most * {percent} + 99) div 100 + 1").cast("int")
    told = sized.join(F.broadcast(most), "part")  # a row for each power of two: 32 at most
    return told.select("item_id", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), k)).alias("token"))


def contained_items(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment of each item held to be in a document."""
    texts = texts_by_id(docs, id_col, text_col)
    items = texts_by_id(benchmark.select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item_id")
    items = materialise(items.withColumn("words", word_list(F.col("text"))).select("item_id", _hashes(F.col("words"), n).alias("hashes"), _strings(F.col("words"), n).alias("shingles")), "items")
    signed = materialise(signatures(items, n, percent), "signatures")
    words = texts.select("doc_id", word_list(F.col("text")).alias("words"))
    looked = words.select("doc_id", F.explode(_hashes(F.col("words"), n)).alias("token"))
    hits = materialise(looked.join(_few(signed), "token").select("doc_id", "item_id").distinct(), "hits")
    some = texts.join(_few(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    mine = some.select("doc_id", word_list(F.col("text")).alias("words")).select("doc_id", _strings(F.col("words"), n).alias("own"))
    by_item = items.select("item_id", "shingles")
    told = mine.join(hits, "doc_id").join(_light(by_item, "shingles"), "item_id")
    both = told.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item"), F.size(F.array_intersect("own", "shingles")).cast("long").alias("n_common"))
    return both.filter(F.col("n_common") * 100 >= F.col("n_item") * percent).withColumn("containment", F.col("n_common") / F.col("n_item"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    found = materialise(contained_items(docs, benchmark, n, percent).select("doc_id").distinct(), "contaminated")
    return docs.join(_few(found), "doc_id", "left_anti").select(docs.columns)
