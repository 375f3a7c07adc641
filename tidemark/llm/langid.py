"""Operator 8: language identification by averaged hashed subword embeddings.

Byte n-grams of the lower-cased text, with white space as the border of words,
are hashed into BUCKETS rows of an embedding table.  A text is the mean of its
rows; a linear layer and a softmax give its language.  Both are trained by
stochastic gradient descent in numpy on the driver, on whole texts and on short
pieces of them, from at most ``rows`` labelled documents (per language the ones
with the smallest hash of their id).  Every fifth of them only serves to fit the
temperature of the softmax and the score below which a prediction counts as
rejected: at it, 95 % of the held-back pieces are right.

Edge cases: lang_pred is ``und``, the score 0 and rejected true where the text is
null or has no letter; every input row gives one row, repeated rows and null ids
included; a null id is not held out and not learned from; without any
labelled row everything is ``und``; long texts are counted in pieces, and memory
does not grow with the number of languages times the bytes of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textbuf import LOWER, SPACE, column_bytes, slices

BUCKETS, DIMENSIONS, ROWS, GRAMS = 4096, 16, 1500, (1, 2, 3, 4)
UND = "und"
#: Bytes of one text, and texts, whose n-grams are counted at once.
PIECE_BYTES, ROWS_AT_ONCE = 1 << 18, 128
_FOLD = LOWER.copy()
_FOLD[SPACE] = 32
_FOLD[48:58] = 48


def gram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each n: the bucket of the n-gram that starts at each byte."""
    folded = _FOLD[data].astype(np.uint32)
    key, out = np.zeros(len(folded), np.uint32), []
    for n in GRAMS:
        if len(folded) < n:
            break
        key = key[: len(folded) - n + 1] * np.uint32(256) + folded[n - 1 :]
        h = (key ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        out.append((h >> np.uint32(20)).astype(np.int64))
    return out


def counts(raw: bytes) -> np.ndarray:
    return bucket_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0]


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: its n-grams in each bucket, and in all.  One long text is counted a piece at a time."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    total, number = np.zeros((rows, BUCKETS), np.float32), np.zeros(rows)
    if rows == 1 and len(data) > PIECE_BYTES:
        sums, most = np.zeros(BUCKETS), max(GRAMS)
        for lo in range(0, len(data), PIECE_BYTES):
            piece = data[lo : lo + PIECE_BYTES + most - 1]
            for b in gram_buckets(piece):
                own = b[:PIECE_BYTES]
                sums += np.bincount(own, minlength=BUCKETS)
                number[0] += len(own)
        return sums.astype(np.float32)[None], number
    owner = np.repeat(np.arange(rows), size)
    left = offsets[1:][owner] - np.arange(len(data))
    for n, buckets in zip(GRAMS, gram_buckets(data)):
        live = left[: len(buckets)] >= n  # n-grams that cross into the next text are left out
        total += np.bincount(owner[: len(buckets)][live] * BUCKETS + buckets[live], minlength=rows * BUCKETS).reshape(rows, BUCKETS)
        number += np.maximum(size - n + 1, 0)
    return total, number


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    table: np.ndarray | None = None  # embedding @ linear layer: one row of logits for each bucket
    bias: np.ndarray | None = None
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i in range(0, len(out), ROWS_AT_ONCE):
            at = offsets[i : i + ROWS_AT_ONCE + 1]
            total, number = bucket_counts(data[at[0] : at[-1]], at - at[0])
            out[i : i + ROWS_AT_ONCE] = (total @ self.table) / np.maximum(number, 1)[:, None]
        return (out + self.bias) / self.temperature

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(data, offsets))
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray, languages: list[str], epochs: int = 12, seed: int = 3) -> Model:
    """x: mean n-gram counts of pieces; check: pieces held back for the calibration."""
    rng, k = np.random.default_rng(seed), len(languages)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    linear, bias = rng.normal(0, 0.1, (DIMENSIONS, k)).astype(np.float32), np.zeros(k, np.float32)
    mine = np.flatnonzero(~check)
    for epoch in range(epochs):
        rate = 8.0 * (1 - epoch / epochs)
        order = rng.permutation(mine)
        for i in range(0, len(order), 32):
            b = order[i : i + 32]
            hidden = x[b] @ embed
            g = softmax(hidden @ linear + bias)
            g[np.arange(len(b)), y[b]] -= 1
            g /= len(b)
            back = g @ linear.T
            linear -= rate * 0.3 * (hidden.T @ g)
            bias -= rate * 0.01 * g.sum(0)
            embed -= rate * (x[b].T @ back) * 10
    model = Model(languages, embed @ linear, bias)
    held = np.flatnonzero(check) if check.any() else mine
    z = x[held] @ model.table + bias
    trials = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]
    model.temperature = min(trials, key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-9).mean())
    p = softmax(z / model.temperature)
    top, right = p.max(1), p.argmax(1) == y[held]
    order = np.argsort(-top, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= 0.95 * np.arange(1, len(order) + 1))
    model.reject = float(top[order[good[-1]]]) if len(good) else 1.0
    return model


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            raw = (text or "").encode()
            rng = np.random.default_rng(abs(doc) % 2**32)
            parts = [raw]
            for size in (20, 80):
                if len(raw) > size:
                    at = int(rng.integers(0, len(raw) - size))
                    parts.append(raw[at : at + size])
            for k, part in enumerate(parts):
                x = counts(part)
                at = np.flatnonzero(x)
                if len(at):
                    out.append((doc, k, lang, at.astype("<u2").tobytes(), (x[at] / x.sum()).astype("<f4").tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["doc_id", "piece", "lang", "at", "share"])


def train(docs: DataFrame, rows: int = ROWS) -> Model:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    mine = base.filter("doc_id is not null and lang is not null and text is not null and pmod(crc32(cast(doc_id as string)), 4) != 2")
    kinds = mine.select("lang").distinct().count()
    if kinds == 0:
        return Model()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = mine.select("doc_id", "lang").withColumn("k", F.row_number().over(first)).filter(F.col("k") <= max(1, rows // kinds)).select("doc_id").distinct()
    found = mine.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", "text").mapInArrow(_pieces, "doc_id long, piece int, lang string, at binary, share binary").orderBy("doc_id", "piece", "lang", "at").limit(3 * max(rows, kinds)).collect()
    languages = sorted({r.lang for r in found})
    if not languages:
        return Model()
    x = np.zeros((len(found), BUCKETS), np.float32)
    for i, r in enumerate(found):
        x[i, np.frombuffer(r["at"], "<u2").astype(np.int64)] = np.frombuffer(r.share, "<f4")
    y = np.array([languages.index(r.lang) for r in found])
    return fit(x, y, np.array([r.doc_id % 5 == 0 for r in found]), languages)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            data, offsets = column_bytes(column)
            for i, j in slices(offsets, PIECE_BYTES):
                if model.languages:
                    best, score = model.predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    names = np.array(model.languages, object)[best]
                else:
                    names, score = np.full(j - i, UND, object), np.zeros(j - i)
                known = lettered[i:j].astype(bool) & bool(model.languages)
                score = np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.where(known, names, UND), pa.string()), pa.array(score), pa.array(~known | (score < model.reject))], names=["doc_id", "lang_pred", "score", "rejected"])

    text = F.col("text").cast("string")
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    told = told.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return told.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
