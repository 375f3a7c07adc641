"""Experiments described in TOML: which layouts and operators, which elements, which queries."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import config_hash
from ..operators import build, workload
from ..operators.specs import Operator, parse_operator
from ..plans.layout import parse_decay
from . import streams

#: Names of distributions and of their parameters, in order: fixed values of the file format.
DISTRIBUTIONS = {
    "ExponentialDistribution": ("exponential", "lambda"),
    "ParetoDistribution": ("pareto", "xm", "alpha"),
    "UniformDistribution": ("uniform", "min", "max"),
    "ZipfDistribution": ("zipf", "N", "k"),
    "FixedDistribution": ("fixed", "value"),
}


def distribution(spec: dict) -> tuple:
    """(sampler, parameters...) of a table such as {distribution = "UniformDistribution", min = 1, max = 100}."""
    name = spec.get("distribution")
    if name not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution: {name}")
    sampler, *keys = DISTRIBUTIONS[name]
    return sampler, *(spec[k] for k in keys)


@dataclass(frozen=True)
class Config:
    decays: tuple[str, ...]
    operators: tuple[Operator, ...]
    data: dict
    workload: dict = field(default_factory=dict)
    streams: int = 1
    buffer: int = 0

    @classmethod
    def parse(cls, text: str) -> Config:
        """Raises ValueError for an unknown layout or operator and KeyError for a missing part."""
        raw = tomllib.loads(text)
        for d in raw["decay-functions"]:
            parse_decay(d)
        return cls(tuple(raw["decay-functions"]), tuple(map(parse_operator, raw["operators"])), raw["data"], raw.get("workload", {}), raw.get("streams", {}).get("nstreams", 1), raw.get("ingest-buffer-size", 0))

    @classmethod
    def load(cls, path: str) -> Config:
        return cls.parse(Path(path).read_text(encoding="utf-8"))

    def name(self) -> str:
        """Names the elements: the same for the same data section."""
        return config_hash({"data": self.data, "streams": self.streams})

    @property
    def span(self) -> tuple[int, int]:
        return self.data["tstart"], self.data["tend"]

    def elements(self, spark: SparkSession) -> DataFrame:
        """The elements of all streams within the span, landmarks tagged as tag-landmarks says (threshold or numSDs)."""
        t0, t1 = self.span
        if "file" in self.data:
            e = streams.csv(spark, self.data["file"], 0, t0, t1)
        else:
            gaps, values = distribution(self.data["interarrivals"]), distribution(self.data["values"])
            n, make = self._enough(gaps), lambda n: streams.synthetic(spark, n, gaps, values, t0, self.data.get("random-seed", 0), self.streams)
            while make(n).groupBy("stream_id").agg(F.max("ts").alias("last")).agg(F.min("last")).first()[0] < t1:
                n *= 2  # the first elements stay the same
            e = make(n).filter(F.col("ts").between(t0, t1))
        tag = self.data.get("tag-landmarks", {})
        if "numSDs" in tag:
            return build.deviation_landmarks(e, tag["numSDs"])
        return e.withColumn("is_landmark", (F.col("value") >= tag["threshold"]) if "threshold" in tag else F.lit(False))

    def _enough(self, gaps: tuple) -> int:
        """Elements to begin with: a tenth and 1000 more than the mean gap asks for."""
        kind, *p = gaps
        mean = {"exponential": lambda: 1 / p[0], "pareto": lambda: p[0] * p[1] / (p[1] - 1) if p[1] > 1 else p[0], "uniform": lambda: (p[0] + p[1]) / 2, "fixed": lambda: p[0], "zipf": lambda: 1}[kind]()
        return int((self.span[1] - self.span[0]) / mean * 1.1) + 1000

    def queries(self, spark: SparkSession) -> DataFrame:
        """The workload by its generator's name (WORKLOADS); with operators, the queries are typed."""
        made = WORKLOADS[self.workload.get("generator", "calendar")](spark, *self.span, self.workload)
        operators = [{"type": o["type"], "param": _param(o.get("param"))} for o in self.workload.get("operators", [])]
        return workload.typed(made, operators) if operators else made


def _param(spec: dict | None):
    return distribution(spec) if spec and "distribution" in spec else spec


def _bins(spark: SparkSession, spec: dict, smallest: str) -> DataFrame:
    return workload.calendar_bins(spark, spec.get("smallest-bin", smallest))


def _calendar(spark: SparkSession, t0: int, t1: int, spec: dict) -> DataFrame:
    return workload.calendar_workload(_bins(spark, spec, "subsecond"), t0, t1, spec.get("ticks-per-second", 1))


def _sampled(spark: SparkSession, t0: int, t1: int, spec: dict) -> DataFrame:
    bins = _bins(spark, spec, "seconds")
    every = workload.rescaled_workload(bins, t0, t1) if spec.get("rescale-to-year") else workload.calendar_workload(bins, t0, t1, spec.get("ticks-per-second", 1))
    return workload.sampled(every, spec["queries-per-class"], spec.get("random-seed", 0)) if "queries-per-class" in spec else every


#: Generators of workloads by name: (spark, first time, last time, the workload section) -> queries.  More can be added.
WORKLOADS = {"calendar": _calendar, "sampled-calendar": _sampled}
