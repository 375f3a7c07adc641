"""Operator 2: quality scores by Bradley-Terry ranking.

A preference pair is a document labelled 1 and one labelled 0; the probability
that the first is preferred is the logistic function of the difference of two
linear scores, so its loss depends on the difference of two feature vectors.
The features are shares of kinds of bytes and of words in the whole text.  The
cut is a quantile of the scores of all labelled rows that are not held out: the one
with the fewest errors at the labels' own proportions, between two of the BINS of a
histogram of what the scores can be.  Scores are shifted so that the cut lies at
CUT = 0.3.

The model is fitted on at most ``per_label`` rows of each label, the ones with the
smallest hash of their id; everything else covers all rows.

Edge cases: a null or empty text has the features of the empty text and is
scored; texts beyond SLICE_BYTES are counted in pieces; every input row gives one row, repeated rows and null ids included; a
null id is never held out and never labelled; labels other than 0 and 1 are
ignored; without rows of both labels every score is 0.5 (kept).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbuf import SLICE_BYTES, column_bytes, lean, slices, space_pieces, word_prints, words

PER_LABEL, PAIRS, CUT, BINS = 2000, 40_000, 0.3, 1 << 17

#: Kinds of bytes: 1 upper, 2 lower, 3 digit, 4 white space, 5 ! and ?, 6 | and / and \, 7 other symbols, 8 stops and commas, 9 quotes and brackets, 10 beyond ASCII, 0 control.
KIND = np.zeros(256, np.uint8)
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\x0c\r", b"!?", b"|/\\", b"#$%&*+<=>@^_`~", b".,;:-", b"\"'()[]{}", bytes(range(128, 256)))):
    KIND[list(_set)] = _k + 1
KINDS = 11


#: What tallies() counts of a text: bytes of each kind, words of eight kinds, words, their bytes, ends of lines, bytes, distinct words.
TALLIES = KINDS + 13


def tallies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each text, and the fingerprints of all words in order."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows, dtype=np.int32), size)
    kinds = np.bincount(owner * KINDS + KIND[data], minlength=rows * KINDS).reshape(rows, KINDS)
    start, end, row = words(data, offsets)
    per = lambda mask: np.bincount(row[mask], minlength=rows)
    prints = word_prints(data, start, end)
    again, fresh = np.zeros(len(start), bool), np.ones(len(start), bool)
    order = np.lexsort((prints, row))
    if len(start):
        again[1:] = (prints[1:] == prints[:-1]) & (row[1:] == row[:-1])
        fresh[1:] = (prints[order][1:] != prints[order][:-1]) | (row[order][1:] != row[order][:-1])
    length = end - start
    lead, tail = (KIND[data[start]], KIND[data[end - 1]]) if len(start) else (np.zeros(0, np.uint8),) * 2
    kinds_of_words = [per(again), per(length <= 2), per(length >= 15), per(lead == 1), per(tail == 5), per(tail == 7), per(tail == 8), per((length == 1) & (lead == 6))]
    rest = [np.bincount(row, minlength=rows), np.bincount(row, weights=length, minlength=rows), np.bincount(owner[data == 10], minlength=rows), size, np.bincount(row[order][fresh], minlength=rows)]
    return np.concatenate([kinds, np.stack(kinds_of_words + rest, 1)], 1).astype(np.float64), prints


def _long_tallies(data: np.ndarray) -> np.ndarray:
    """tallies() of one text, a piece at a time; its distinct words and the last word are carried along."""
    total, seen, last = np.zeros((1, TALLIES)), np.zeros(0, np.uint64), None
    for lo, hi in space_pieces(data):
        counts, prints = tallies(data[lo:hi], np.array([0, hi - lo]))
        total += counts
        if len(prints):
            total[0, KINDS] += last is not None and prints[0] == last
            last = prints[-1]
            seen = np.union1d(seen, prints)
    total[0, -1] = len(seen)
    return total


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text."""
    t = _long_tallies(data) if len(offsets) == 2 and len(data) > SLICE_BYTES else tallies(data, offsets)[0]
    kinds, of_words, (count, length, breaks, size, fresh) = t[:, :KINDS], t[:, KINDS : KINDS + 8], t[:, KINDS + 8 :].T
    n, w = np.maximum(size, 1), np.maximum(count, 1)
    shares = np.concatenate([kinds / n[:, None], of_words / w[:, None]], 1)
    distinct = fresh / w
    other = np.stack([distinct, distinct * np.log1p(count), np.log1p(size), np.log1p(count), length / w / 10, np.log1p(count / (breaks + 1)), (count == 0) * 1.0], 1)
    return np.concatenate([shares, np.log1p(200 * shares), other], 1)


@dataclass
class Ranker:
    """score = logistic(raw - cut + logit(CUT))"""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weight: np.ndarray | None = None
    cut: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), 0.5)
        z = np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -50, 50)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 7) -> Ranker:
    """Gradient descent on the logistic loss of feature differences; the cut is left at 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(good) == 0 or len(bad) == 0:
        return Ranker()
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    first, second = rng.choice(good, pairs), rng.choice(bad, pairs)
    weight, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, steps + 1):
        pick = rng.integers(0, pairs, 2000)
        d = z[first[pick]] - z[second[pick]]
        g = -(d / (1 + np.exp(np.clip(d @ weight, -50, 50)))[:, None]).mean(0) + 1e-3 * weight
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weight -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Ranker(mean, scale, weight)


def best_cut(low: np.ndarray, high: np.ndarray, bad: np.ndarray, good: np.ndarray, share_of_0: float) -> float:
    """The cut between two bins, in ascending order, with the fewest errors; bins have a least and a greatest score and rows of each label."""
    gain = (1 - share_of_0) * good / good.sum() - share_of_0 * bad / bad.sum()
    error = np.concatenate([[0], np.cumsum(gain)])  # of rejecting so many of the lowest, less that of rejecting none
    best = np.flatnonzero(error <= error.min() + 1e-12)
    at = int(best[len(best) // 2])
    below, above = np.concatenate([[low[0] - 1], high]), np.concatenate([low, [high[-1] + 1]])
    return float((below[at] + above[at]) / 2)


def _learnable(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1) and pmod(crc32(cast(doc_id as string)), 5) != 0")


def _labelled(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Features and labels of the rows to learn from, and the share of label 0 among all such labels."""
    mine = _learnable(labels)
    counts = {r.quality: r["count"] for r in mine.groupBy("quality").count().collect()}
    if set(counts) != {0, 1}:
        return np.zeros((0, 0)), np.zeros(0), 0.5
    taken = mine.filter("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).unionByName(mine.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label))
    few = taken.groupBy("doc_id").agg(F.min("quality").alias("quality"))  # at most 2 * per_label rows of 12 bytes, whatever the tables' size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(few), "doc_id").select("doc_id", "text", "quality").mapInArrow(lean(run), "doc_id long, quality int, x binary").orderBy("doc_id", "x").limit(2 * per_label).collect()
    if not found:
        return np.zeros((0, 0)), np.zeros(0), 0.5
    return np.stack([np.frombuffer(r.x) for r in found]), np.array([r.quality for r in found]), counts[0] / (counts[0] + counts[1])


def _histogram(docs: DataFrame, labels: DataFrame, ranker: Ranker) -> tuple[np.ndarray, ...]:
    """low, high, bad, good of each bin of raw scores that all rows to learn from fill: at most BINS rows, whatever the tables' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                raw = ranker.raw(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(raw)], names=["doc_id", "raw"])

    most = 8 * float(np.abs(ranker.weight).sum()) + 1e-9  # features are clipped at 8
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) != 0")
    told = texts.mapInArrow(lean(run), "doc_id long, raw double").join(_learnable(labels).groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    place = F.floor((F.col("raw") + most) * (BINS / (2 * most)))
    bins = told.groupBy(place.alias("bin")).agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.sum(1 - F.col("quality")).alias("bad"), F.sum("quality").alias("good"))
    found = bins.toArrow().sort_by("bin")
    return tuple(found[c].to_numpy() for c in ("low", "high", "bad", "good"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Ranker:
    x, y, share_of_0 = _labelled(docs, labels, per_label)
    ranker = fit(x, y)
    if ranker.weight is not None:
        ranker.cut = best_cut(*_histogram(docs, labels, ranker), share_of_0)
    return ranker


def score_documents(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                score = ranker.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double, predicted int")
    return told.select("doc_id", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(names.index("text")))
            for i, j in slices(offsets):
                score = ranker.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                kept = batch.slice(i, j - i).filter(pa.array(score >= CUT))
                if len(kept):
                    yield kept

    return docs.mapInArrow(lean(run), docs.schema)
