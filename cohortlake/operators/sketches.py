"""Approximate distinct counts: a sketch for each segment (and slice), merged and estimated at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.plans.config import Metric

from .cells import SEGMENT


def slices(metric: Metric) -> list[str]:
    return [f"dim_{s}" for s in metric.sliceBy or []]


def sketch(df: DataFrame, metric: Metric, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """(segment, slices, sketch): records with a null slice are left out."""
    by = slices(metric)
    kept = df.dropna(subset=by) if by else df
    return kept.groupBy(*keys, *by).agg(F.hll_sketch_agg(F.col(f"field_{metric.field}").cast("string"), F.lit(metric.precision)).alias("sketch"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The estimate over all segments, for each value of by."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch")).withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")
