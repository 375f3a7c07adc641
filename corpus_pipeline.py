"""A corpus from raw documents to token ids, in five stages.

quality: documents that the classifier rejects go.  near_duplicates: of each group
of near duplicates the one with the smallest id stays.  repeated_passages: bytes
that an earlier document, or an earlier place of the same one, already has in a
stretch of 100 are cut out; a document of which nothing is left goes.
decontamination: documents that hold a benchmark item go.  tokens: the ids of what
is left.  All stages but the last return the columns of documents, whatever other
columns there are and whatever their names.

Edge cases.  Null and empty texts: quality scores them as any text; without words
they are near duplicates of nothing; nothing is cut out of them; they hold no item
and have no tokens.  Null ids: quality keeps or rejects such rows by their texts;
from near_duplicates on they are left out, since a decision names an id.  Rows that
share an id: quality judges each row; near_duplicates keeps one, with the smallest
text, and of equal texts the one with the smallest hash of all columns; later stages
have one row for each id.  Ties and repeated rows: the smallest id stays, and the
earliest place.  Long texts are taken whole.  Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, suffix_dedup
from tidemark.llm import quality as quality_model
from tidemark.llm.frames import discard, materialise, one_row_per_id, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialise(jaccard_join.near_duplicate_components(docs), "groups")
    lost = groups.filter("doc_id != component_id").select("doc_id")
    few = lost.count() <= jaccard_join.BROADCAST_IDS
    return one_row_per_id(docs).join(F.broadcast(lost) if few else lost, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(docs).select("doc_id", "kept", "n_removed")
    rows = one_row_per_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row")).join(cut, "doc_id").filter("n_removed = 0 or kept != ''")
    some = F.col("n_removed") > 0
    new = {"text": F.when(some, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(some, F.length("kept").cast("long")).otherwise(F.col("row").getField("n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*((new[c] if new.get(c) is not None else F.col("row").getField(c)).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("tokens", tokens)]

#: The classifier and the byte cuts cannot be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
