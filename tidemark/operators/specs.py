"""Operator specifications: CountOperator, SumOperator, MaxOperator, CMSOperatorD,W, BloomFilterOperatorK,M, DistinctOperator, QuantileOperator."""

from __future__ import annotations

import re
from dataclasses import dataclass

KINDS = {"Count": "COUNT", "SimpleCount": "COUNT", "Sum": "SUM", "Max": "MAX", "CMS": "CMS", "BloomFilter": "BLOOM", "Distinct": "DISTINCT", "HyperLogLog": "DISTINCT", "Quantile": "FREQ", "TDigest": "FREQ"}


@dataclass(frozen=True)
class Operator:
    name: str
    kind: str
    params: tuple[int, ...] = ()


def parse_operator(spec: str) -> Operator:
    m = re.fullmatch(r"(\w+?)Operator(\d+(?:,\d+)*)?", spec)
    if not m or m[1] not in KINDS:
        raise ValueError(f"unknown operator: {spec}")
    return Operator(m[1], KINDS[m[1]], tuple(int(x) for x in m[2].split(",")) if m[2] else ())
