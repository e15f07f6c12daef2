"""Exact selection of an order statistic without sorting: an interval of values is narrowed by histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column without nulls; infinity for k = 0, minus infinity beyond the rows.

    Each step reads the column once and sends the driver BINS rows at most.
    """
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
    if k <= 0:
        return math.inf
    if k > n:
        return -math.inf
    above = 0
    while lo < hi:
        width = (hi - lo) / BINS
        at = F.least(F.floor((F.col(column) - lo) / width) if width > 0 else F.lit(0), F.lit(BINS - 1))
        bins = df.where(F.col(column).between(lo, hi)).groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        found = sorted(bins.collect(), key=lambda r: -r["lo"])
        for b in found:
            if above + b["n"] >= k:
                if (b["lo"], b["hi"]) == (lo, hi):  # neighbours in floating point
                    return hi if above + df.where(F.col(column) == hi).count() >= k else lo
                lo, hi = b["lo"], b["hi"]
                break
            above += b["n"]
    return lo
