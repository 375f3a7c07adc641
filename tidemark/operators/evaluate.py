"""Errors, distributions and layout optimisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.layout import layout


def relative_error(estimate: Column, truth: Column) -> Column:
    return F.abs(estimate - truth) / (F.abs(truth) + 1)


def error_profile(answers: DataFrame, *classes: str) -> DataFrame:
    """Per class: queries, mean and p95 error, p95 interval width, and the share of true answers outside of the interval."""
    e = relative_error(F.col("result"), F.col("truth"))
    width = (F.col("ci_high") - F.col("ci_low")) / (F.abs(F.col("truth")) + 1)
    miss = (F.col("truth") < F.col("ci_low") - 1e-9) | (F.col("truth") > F.col("ci_high") + 1e-9)
    return answers.groupBy(*classes).agg(F.count("*").alias("n"), F.avg(e).alias("error_mean"), F.percentile(e, 0.95).alias("error_p95"), F.percentile(width, 0.95).alias("ci_width_p95"), F.avg(miss.cast("double")).alias("ci_miss_rate"))


def observation_stats(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("low"), F.max(column).alias("high"))


def rms_error(frame: DataFrame, estimate: str, truth: str) -> DataFrame:
    """sqrt(sum (est - act)^2 / sum act^2) over act > 0."""
    return frame.filter(F.col(truth) > 0).agg(F.sqrt(F.sum((F.col(estimate) - F.col(truth)) ** 2) / F.sum(F.col(truth) ** 2)).alias("rms"))


def histogram_cdf(frame: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, edge, n, cdf): equal bins, each with its right edge; values outside go to the outer bins."""
    at = F.least(F.greatest(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).alias("bin")
    per = frame.filter(F.col(column).isNotNull()).groupBy(at).agg(F.count("*").alias("n"))
    every = frame.sparkSession.range(bins).select(F.col("id").alias("bin")).join(per, "bin", "left").fillna(0, ["n"])
    run = Window.orderBy("bin")  # so many rows as bins
    return every.select("bin", (F.lit(low) + (F.col("bin") + 1) * ((high - low) / bins)).alias("edge"), "n", (F.sum("n").over(run) / F.sum("n").over(Window.partitionBy())).alias("cdf"))


def mixture_cdf(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """The distribution of a weighted mixture of histograms with the same bins: (bin, edge, cdf)."""
    total, told = sum(w for _, w in parts), None
    for h, w in parts:
        h = h.select("bin", "edge", (F.col("cdf") * (w / total)).alias("cdf"))
        told = h if told is None else told.unionByName(h)
    return told.groupBy("bin", "edge").agg(F.sum("cdf").alias("cdf"))


def cdf_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """quantile: halfway between the last edge whose share is q or less and the first whose share is q or more."""
    found = histogram.agg(F.max(F.when(F.col("cdf") <= q, F.col("edge"))).alias("low"), F.min(F.when(F.col("cdf") >= q, F.col("edge"))).alias("high"))
    return found.select(((F.coalesce("low", "high") + F.coalesce("high", "low")) / 2).alias("quantile"))


def mixture_stats(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Mean, deviation and range of a weighted mixture of observation_stats()."""
    total, told = sum(w for _, w in parts), None
    for s, w in parts:
        s = s.withColumn("w", F.lit(w / total))
        told = s if told is None else told.unionByName(s)
    mean = F.sum(F.col("w") * F.col("mean"))
    square = F.sum(F.col("w") * (F.col("sd") * F.col("sd") + F.col("mean") * F.col("mean")))
    return told.agg(F.sum("n").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("sd"), F.min("low").alias("low"), F.max("high").alias("high"))


def outlier_bins(elements: DataFrame, width: int, threshold: int) -> DataFrame:
    """Bins of time whose sum differs from the bin before by more than a threshold."""
    per = elements.groupBy("stream_id", F.floor(F.col("ts") / width).alias("bin")).agg(F.sum("value").alias("total"))
    before = F.lag("total").over(Window.partitionBy("stream_id").orderBy("bin"))
    return per.withColumn("change", F.col("total") - before).filter(F.abs(F.col("change")) > threshold)


def uniform_measure(n: int) -> np.ndarray:
    return np.ones((n, n))


def zipf_measure(n: int, age_skew: float, length_skew: float) -> np.ndarray:
    """Weight of the interval of age a and length l, in proportion to (a + 1)^-s (l + 1)^-t; all sum to 1."""
    w = (np.arange(1, n + 1)[:, None] ** -age_skew) * (np.arange(1, n + 1)[None, :] ** -length_skew)
    w *= np.arange(n)[:, None] + np.arange(n)[None, :] < n
    return w / w.sum()


def optimal_layout(n: int, windows: int, measure: np.ndarray) -> tuple[list[int], float]:
    """Lengths, oldest first, of so many windows over n bins with the least expected overhang of interval edges.

    An interval whose edge lies inside a window reaches over by the bins of that
    window beyond the edge.  The cost of a window is a sum over its inner edges, so
    the best layout is a shortest path with ``windows`` steps.
    """
    left, right = np.zeros(n), np.zeros(n)  # weight of intervals that begin, or end, at a bin
    for age in range(n):
        for length in range(n - age):
            r = n - 1 - age
            left[r - length] += measure[age, length]
            right[r] += measure[age, length]
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (left, left * np.arange(n), right, right * np.arange(n))]
    a, b = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
    part = lambda s: s[None, :] - s[:, None]
    cost = part(sums[1]) - a * part(sums[0]) + (b - 1) * part(sums[2]) - part(sums[3])
    cost = np.where(a < b, cost, np.inf)
    best, choice = cost[0].copy(), []
    for _ in range(windows - 1):
        total = best[:, None] + cost
        choice.append(total.argmin(0))
        best = total.min(0)
    cuts = [n]
    for c in reversed(choice):
        cuts.append(int(c[cuts[-1]]))
    cuts = [0, *cuts[::-1]]
    return [y - x for x, y in zip(cuts, cuts[1:])], float(best[n])


#: What the error of an interval is divided by, from its true count and that of all intervals (by weight).
METRICS = {"absolute": lambda t, all_: 1.0, "wape": lambda t, all_: all_, "mape": lambda t, all_: t, "relative": lambda t, all_: 1.0 + t}


def _intervals(counts: np.ndarray, measure: np.ndarray, metric: str):
    """(left bin, right bin, weight) of each interval; of MAPE those without elements are left out."""
    n, run = len(counts), np.concatenate([[0], np.cumsum(counts)]).astype(float)
    every = [(n - 1 - age - length, n - 1 - age, measure[age, length]) for age in range(n) for length in range(n - age)]
    total = sum(w * (run[r + 1] - run[l]) for l, r, w in every)
    for l, r, w in every:
        by = METRICS[metric](run[r + 1] - run[l], total)
        if by > 0:
            yield l, r, w / by


def layout_error(counts: np.ndarray, lengths: list[int], measure: np.ndarray, metric: str = "absolute") -> float:
    """The expected error of a layout: of both edges of each interval, by proportional counts."""
    run, edges = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(lengths)])
    off = np.abs(run - np.interp(np.arange(len(run)), edges, run[edges]))
    return float(sum(w * (off[l] + off[r + 1]) for l, r, w in _intervals(counts, measure, metric)))


def value_aware_layout(counts: np.ndarray, windows: int, measure: np.ndarray, metric: str = "absolute") -> tuple[list[int], float]:
    """As optimal_layout, but the cost is the error of proportional counts at the edges, for known counts per bin, by one of METRICS."""
    n = len(counts)
    run = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    left, right = np.zeros(n + 1), np.zeros(n + 1)
    for l, r, w in _intervals(counts, measure, metric):
        left[l] += w
        right[r + 1] += w
    cost = np.full((n + 1, n + 1), np.inf)
    for i in range(n):
        for j in range(i + 1, n + 1):
            at = np.arange(i, j + 1)
            error = np.abs(run[at] - (run[i] + (run[j] - run[i]) * (at - i) / (j - i)))
            cost[i, j] = (error * (left[at] + right[at]))[1:-1].sum()
    best, choice = cost[0].copy(), []
    for _ in range(windows - 1):
        total = best[:, None] + cost
        choice.append(total.argmin(0))
        best = total.min(0)
    cuts = [n]
    for c in reversed(choice):
        cuts.append(int(c[cuts[-1]]))
    cuts = [0, *cuts[::-1]]
    return [y - x for x, y in zip(cuts, cuts[1:])], float(best[n])


def by_age_and_length(l: int, r: int, n: int) -> tuple[int, int]:  # noqa: E741
    """(age, length) of the interval of bins [l, r], both from 0, in n bins."""
    return n - 1 - r, r - l


def by_edges(age: int, length: int, n: int) -> tuple[int, int]:
    return n - 1 - age - length, n - 1 - age


def binned_stream(n: int, rate: float, seed: int = 0) -> np.ndarray:
    """Elements of a Poisson stream in each of n bins."""
    return np.random.default_rng(seed).poisson(rate, n)


def storage_against_error(counts: np.ndarray, measure: np.ndarray, windows: list[int], decays: list[str], metric: str = "absolute") -> list[tuple[str, int, float]]:
    """(layout, windows, error): the best layouts of so many windows, and those of decays over the bins."""
    out = [("best", w, value_aware_layout(counts, w, measure, metric)[1]) for w in windows]
    for d in decays:
        lengths = [b - a + 1 for a, b in layout(d, len(counts))]
        out.append((d, len(lengths), layout_error(counts, lengths, measure, metric)))
    return out


def error_by_age_and_length(counts: np.ndarray, lengths: list[int]) -> list[tuple[int, int, float]]:
    """(age, length, relative error) of every interval of a layout."""
    n, out = len(counts), []
    for age in range(n):
        for length in range(n - age):
            one = np.zeros((n, n))
            one[age, length] = 1
            out.append((age, length, layout_error(counts, lengths, one, "relative")))
    return out


def heat_map(profile: DataFrame, value: str = "error_p95") -> DataFrame:
    """A row for each age class and a column for each length class of a profile."""
    return profile.groupBy("age_class").pivot("length_class").agg(F.first(value))


def landmark_mode_bins(elements: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """Bins of time with their sums, and of what remains when values of high and above, and of middle, are kept as landmarks: (stream_id, bin, total, low_sum, middle_sum, high_sum)."""
    v = F.col("value")
    part = lambda c: F.coalesce(F.sum(F.when(c, v)), F.lit(0))
    return elements.groupBy("stream_id", F.floor(F.col("ts") / width).alias("bin")).agg(F.sum("value").alias("total"), part(v < low).alias("low_sum"), part((v >= low) & (v < high)).alias("middle_sum"), part(v >= high).alias("high_sum"))
