"""Operator 1: licence scan by ordered signature rules, in Spark functions only.

A text's words are looked at by a rule only around a keyword: the text must hold
one of the rules' anchors at all, and a rule is tried only at places of its own
anchor, on the words near it.  Detections are intervals of words.  One that lies
inside another, or equals one of a rule with higher priority, is suppressed;
phrases of the contract (base) count in any case.

There is no shuffle: a row's detections are arrays of that row, in proportion to
its anchors, so frequent lines and long texts cost what their length costs.

Edge cases: a null or empty text has no words, no labels (empty strings), null
places and the score 0; every input row gives one row, repeated rows and null ids
included.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import AFTER, ANCHORS, BEFORE, RULES
from .native import word_list

#: Detections whose greatest stop is found at once.
BLOCK = 256

_RULE = "struct<priority:int,label:string,weight:double,base:boolean,key:string,pattern:string>"
_DETECTION = "struct<start:int,behind:int,priority:int,label:string,weight:double,base:boolean>"


def _constant(value, kind: str) -> Column:
    """A literal of a nested type; it is folded once, when the query is planned."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rules_by_anchor() -> Column:
    """For each of ANCHORS, its rules."""
    return _constant([[{k: getattr(r, k) for k in ("priority", "label", "weight", "base", "key", "pattern")} for r in RULES if a in r.anchors] for a in ANCHORS], f"array<array<{_RULE}>>")


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _at_anchor(words: Column, i: Column) -> Column:
    """Detections of the anchor at word i; behind is -stop, so that they sort by start, then the longest, then priority."""
    first = F.greatest(i - BEFORE, F.lit(0))
    around = F.concat(F.lit(" "), F.array_join(F.slice(words, first + 1, i - first), " "), F.when(i > 0, F.lit(" |")).otherwise(F.lit("|")), F.array_join(F.slice(words, i + 1, F.lit(AFTER)), " "), F.lit(" "))
    mine = F.element_at(_rules_by_anchor(), F.array_position(_constant(ANCHORS, "array<string>"), F.element_at(words, i + 1)).cast("int"))

    def tried(near: Column) -> Column:
        hits = F.transform(F.filter(mine, lambda r: F.contains(near, r["key"])), lambda r: F.struct(r.alias("r"), F.call_function("regexp_extract", near, r["pattern"], F.lit(0)).alias("hit")))
        return F.transform(F.filter(hits, lambda d: F.length(d["hit"]) > 0), place)

    def place(d: Column) -> Column:
        left, right = F.substring_index(d["hit"], "|", 1), F.substring_index(d["hit"], "|", -1)
        r = d["r"]
        return F.struct((i - (_count(left, " ") - 1)).alias("start"), (-(i + _count(right, " "))).alias("behind"), *(r[k].alias(k) for k in ("priority", "label", "weight", "base")))

    return F.flatten(F.transform(F.array(around), tried))  # an array of one: the words around are joined once


def _once(value: Column, use) -> Column:
    """use(value), the value worked out once: an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _outermost(found: Column) -> Column:
    """Detections that no other contains.

    In order of start, then of greatest stop, then of priority, whatever contains a
    detection stands before it, and all before it start no later: so one is contained
    just when the greatest stop (the least behind) before it is no less than its own.
    That is found by blocks, so that the work does not grow with the square of a
    text's detections.
    """
    none = F.lit(2**31 - 1)

    def kept(behind: Column, before: Column) -> Column:
        def inside(d: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return (F.element_at(before, block + 1) <= d["behind"]) | F.exists(F.slice(behind, block * BLOCK + 1, i - block * BLOCK), lambda e: e <= d["behind"])

        return F.filter(found, lambda d, i: ~inside(d, i))

    blocks = lambda behind: F.sequence(F.lit(0), F.floor(F.size(behind) / BLOCK).cast("int"))
    least = lambda behind: F.transform(blocks(behind), lambda b: F.coalesce(F.array_min(F.slice(behind, b * BLOCK + 1, BLOCK)), none))
    before = lambda mins: F.transform(mins, lambda _, b: F.coalesce(F.array_min(F.slice(mins, F.lit(1), b)), none))
    return _once(F.transform(found, lambda d: d["behind"]), lambda behind: _once(least(behind), lambda mins: _once(before(mins), lambda run: kept(behind, run))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections array<struct<start, stop, label, weight>>."""
    anchors = _constant(ANCHORS, "array<string>")
    split = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_list(F.col(text_col)).alias("words"))
    gated = split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", anchors), F.col("words")).alias("words"))
    spots = gated.withColumn("spots", F.when(F.col("words").isNotNull(), F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(anchors, F.element_at("words", i + 1)))))
    found = spots.withColumn("found", F.when(F.col("words").isNotNull(), F.array_sort(F.flatten(F.transform("spots", lambda i: _at_anchor(F.col("words"), i))))))
    none = F.array().cast(f"array<{_DETECTION}>")
    found = found.select("doc_id", "n_words", F.coalesce("found", none).alias("found"))
    based = F.filter("found", lambda d: d["base"])
    kept = found.select("doc_id", "n_words", based.alias("based"), _outermost(F.col("found")).alias("kept"))
    labels = lambda c: F.transform(c, lambda d: d["label"])
    starts = F.transform("based", lambda d: d["start"].cast("long"))
    return kept.select(
        "doc_id",
        "n_words",
        F.size("based").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(labels("based"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels("based"), labels("kept"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
        F.transform("kept", lambda d: F.struct(d["start"].alias("start"), (-d["behind"]).alias("stop"), d["label"].alias("label"), d["weight"].alias("weight"))).alias("detections"),
    )
