"""Queries over cells: filters as member sets of each segment, aggregates, facets, time series.

One aggregation by (segment, member) gives the flags of all leaves of a filter, over the records
that meet some leaf wherever a filter needs no others. What follows sees one row for each member
of a segment that the filter finds.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlake.functions.durations import duration_ms
from cohortlake.plans.config import IndexConfig, Metric
from cohortlake.plans.filters import Always, Filter, Flags, OneOf, holds, open_ended, parse, ranges

from .cells import SEGMENT, TooManySegments, catalog, postings, pruned
from .sketches import merged, sketch, slices

BUILT_IN = ("cardinality", "count")
SKETCHES = ("ull", "hll", "cpc")
STEPS = ("1h", "6h", "1d")
MOST_FACETS = 1000


class UnsupportedQuery(ValueError):
    pass


def in_universe(cfg: IndexConfig) -> Column:
    """Whether a record puts its member into the segment's universe: some dimension has a value."""
    return F.coalesce(*[F.col(f"dim_{d.name}").cast("string") for d in cfg.dimensions]).isNotNull()


class Engine:
    """Queries over a DataFrame of cells. The times of all queries are in milliseconds; segments that overlap [start, end) count whole.

    keys name the columns that tell segments apart. Where **where stands, start, end and parts may be given.
    """

    def __init__(self, cells: DataFrame | None, cfg: IndexConfig, keys: Sequence[str] = SEGMENT):
        self.given, self.cfg, self.keys = cells, cfg, tuple(keys)

    # what answers are made of; a store has these ready

    @property
    def cells(self) -> DataFrame:
        return self.given

    def pruned(self, start: int | None = None, end: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        return pruned(self.cells, self.cfg, start, end, parts)

    def segments(self) -> DataFrame:
        return catalog(self.cells, self.cfg, self.keys)

    def segment_keys(self, **where) -> DataFrame:
        """The keys of the segments, each once."""
        return self.pruned(**where).select(*self.keys).distinct()

    def hits(self, tree: Filter, canonical: bool = False, keep_outside: bool = False, **where) -> DataFrame:
        """(segment, member) of the members that a filter finds. A member outside the universe is found only by a last value, and only with keep_outside."""
        rows, by_last = self.pruned(**where), frozenset() if canonical else frozenset(self.cfg.experimentalModels.bsiDims)
        last = lambda dim: F.max_by(f"raw_{dim}", F.when(F.col(f"raw_{dim}").isNotNull(), F.col("offset")))
        flags = Flags(lambda leaf: holds(self.cfg, leaf), last, by_last)
        condition, asks_last = flags.condition(tree), any(d in by_last for d in ranges(tree))
        if not open_ended(tree) and not asks_last:
            rows = rows.where(flags.met())  # a record that meets a leaf has a value, so its member is in the universe
        inside = F.bool_or(in_universe(self.cfg)) if not (keep_outside and asks_last) else F.lit(True)
        grouped = rows.groupBy(*self.keys, "member").agg(inside.alias("inside"), *[c.alias(n) for n, c in flags.aggregates.items()])
        return grouped.where(condition & F.col("inside")).select(*self.keys, "member")

    def held(self, **where) -> DataFrame:
        """(segment, member, dim, value), distinct."""
        return postings(self.pruned(**where), self.cfg, self.keys).drop("code")

    def summed(self, metric: Metric, **where) -> DataFrame:
        """(segment, n): a COUNT or SUM metric of each segment; each value is cut to a whole number before it is added."""
        each = F.count("*") if metric.type == "count" else F.coalesce(F.sum(F.col(f"field_{metric.field}").cast("bigint")), F.lit(0))
        return self.pruned(**where).groupBy(*self.keys).agg(each.alias("n"))

    def sketches(self, metric: Metric, **where) -> DataFrame:
        """(segment, slices, sketch)."""
        return sketch(self.pruned(**where), metric, self.keys)

    def weights(self, **where) -> DataFrame:
        """(segment, member, records)."""
        return self.pruned(**where).groupBy(*self.keys, "member").agg(F.count("*").alias("records"))

    # answers

    def guard(self, **where) -> int:
        """The number of segments that a query reads; an error if there are more than the configured most."""
        n = self.segment_keys(**where).count()
        if n > self.cfg.query.maxSegmentsPerQuery:
            raise TooManySegments(f"{n} segments, at most {self.cfg.query.maxSegmentsPerQuery} are allowed")
        return n

    def members(self, filter: str | None = None, canonical: bool = False, **where) -> DataFrame:
        """(segment, member) of the members that a filter finds: the mergeable state of a query."""
        return self.hits(parse(filter), canonical, **where)

    def metric(self, agg: str, tree: Filter) -> Metric | None:
        """The metric that agg names, None for those built in. Sketches have no members, so only that of the members' field can be filtered or sliced."""
        metric = None if agg in BUILT_IN else self.cfg.metric(agg)
        if metric is None and agg not in BUILT_IN:
            raise UnsupportedQuery(f"no aggregate {agg!r}")
        if metric is not None and metric.type in SKETCHES and self.exact(metric, tree) and metric.field != self.cfg.member.field:
            raise UnsupportedQuery(f"{agg} is a sketch of {metric.field}, which no filter or slice can be applied to")
        return metric

    @staticmethod
    def exact(metric: Metric, tree: Filter) -> bool:
        return not isinstance(tree, Always) or bool(metric.sliceBy)

    def query(self, filter: str | None = None, agg: str = "count", canonical: bool = False, **where) -> DataFrame:
        """One row: segments, matched, result, metric, approx.

        cardinality: distinct members; count: members, each once a segment. COUNT and SUM metrics
        read all records of the segments, whatever the filter; sketches are approximate unless
        filtered or sliced, where only the member's own field can be counted.
        """
        tree = parse(filter)
        metric = self.metric(agg, tree)
        zero = F.lit(0).cast("bigint")
        if metric is not None and metric.type not in SKETCHES:
            found = self.summed(metric, **where).agg(F.count("*").alias("segments"), F.coalesce(F.sum("n"), zero).alias("matched")).withColumn("result", F.col("matched"))
            return self._row(found, agg)
        if metric is not None and not self.exact(metric, tree):
            found = self.sketches(metric, **where)
            found = found.agg(F.count("*").alias("segments"), F.lit(-1).cast("bigint").alias("matched"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))), F.lit(0)).cast("double").alias("result"))
            return self._row(found, agg, approx=True)
        hits = self.hits(tree, canonical, **where)
        if agg == "count":
            found = hits.agg(F.count("*").alias("matched")).withColumn("result", F.col("matched"))
        else:  # each shuffle has one key: two distinct counts in one would expand every row
            found = hits.groupBy("member").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), zero).alias("matched"), F.count("*").alias("result"))
        segments = self.segment_keys(**where).agg(F.count("*").alias("segments"))
        both = segments.select("segments", zero.alias("matched"), zero.alias("result")).union(found.select(zero.alias("segments"), "matched", "result"))
        return self._row(both.agg(*[F.sum(c).alias(c) for c in ("segments", "matched", "result")]), agg)

    @staticmethod
    def _row(df: DataFrame, agg: str, approx: bool = False) -> DataFrame:
        return df.select("segments", "matched", "result", F.lit(agg).alias("metric"), F.lit(approx).alias("approx"))

    def sliced(self, agg: str, **where) -> DataFrame:
        """The estimate of a sliced metric for each slice."""
        metric = self.cfg.metric(agg)
        return merged(self.sketches(metric, **where), *slices(metric))

    def records(self, filter: str | None = None, **where) -> DataFrame:
        """Records of the members that a filter finds, in the segments where it finds them."""
        found = self.weights(**where).join(self.hits(parse(filter), **where), [*self.keys, "member"], "left_semi")
        return found.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"))

    def facets(self, filter: str | None = None, top: int = 20, **where) -> DataFrame:
        """(dim, value, count): for every dimension the values that most members of segments have; ties in order of value."""
        held, tree = self.held(**where), parse(filter)
        if not isinstance(tree, Always):
            held = held.join(self.hits(tree, **where), [*self.keys, "member"], "left_semi")
        counted = held.groupBy("dim", "value").agg(F.count("*").alias("count"))
        place = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("count"), "value"))
        return counted.withColumn("place", place).where(F.col("place") <= max(1, min(top, MOST_FACETS))).drop("place")

    def timeseries(self, step: str, filter: str | None = None, agg: str = "count", start: int | None = None, end: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """(step_start, step_end, result) from start to end, by default of all segments. A segment counts in each step that it overlaps."""
        if step not in STEPS:
            raise UnsupportedQuery(f"steps are {', '.join(STEPS)}, not {step!r}")
        tree = parse(filter)
        metric, width, size = self.metric(agg, tree), self.cfg.bucket_ms, duration_ms(step)
        spark = self.cells.sparkSession
        if start is None or end is None:
            bounds = self.segment_keys(parts=parts).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
            start = bounds.lo if start is None else start
            end = (None if bounds.hi is None else bounds.hi + width) if end is None else end
        if start is None or end is None or end <= start:
            return spark.range(0).selectExpr("id AS step_start", "id AS step_end", "id AS result")
        n = -(-(end - start) // size)
        steps = spark.range(n).select(F.col("id").alias("step"), (F.lit(start) + F.col("id") * size).alias("step_start"), F.least(F.lit(start) + (F.col("id") + 1) * size, F.lit(end)).alias("step_end"))
        first = F.greatest(F.floor((F.col("bucket") - F.lit(start)) / size), F.lit(0))
        last = F.least(F.ceil((F.col("bucket") + F.lit(width) - F.lit(start)) / size) - 1, F.lit(n - 1))
        spread, where = F.explode(F.sequence(first, last)).alias("step"), {"start": start, "end": end, "parts": parts}
        if metric is None or (metric.type in SKETCHES and self.exact(metric, tree)):
            counted = self.hits(tree, **where).select("member", spread).groupBy("step").agg((F.count("*") if agg == "count" else F.count_distinct("member")).alias("result"))
        elif metric.type in SKETCHES:
            counted = merged(self.sketches(metric, **where).select("sketch", spread), "step").withColumnRenamed("estimate", "result")
        else:
            counted = self.summed(metric, **where).select("n", spread).groupBy("step").agg(F.sum("n").alias("result"))
        return steps.join(counted, "step", "left").select("step_start", "step_end", F.coalesce("result", F.lit(0)).alias("result"))

    def legacy_cardinality(self, dim: str, value: str) -> DataFrame:
        """One row, result: members with the value, each once a segment, over all segments."""
        if not dim or not value:
            raise UnsupportedQuery("dim and value are needed")
        return self.hits(OneOf(dim, (value,))).agg(F.count("*").alias("result"))

    def bitmaps(self, filter: str | None = None, **where) -> DataFrame:
        """(b, bits): the members that a filter finds, as bitmaps for each bucket of member numbers, which merge by OR."""
        if self.cfg.member.encoding != "raw_uint32":
            warnings.warn("bitmaps need numbers as members", stacklevel=2)
            raise UnsupportedQuery("bitmaps need raw_uint32 members")
        hits = self.members(filter, **where).groupBy(*self.keys, F.bitmap_bucket_number("member").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("member")).alias("bits"))
        return hits.groupBy("b").agg(F.bitmap_or_agg("bits").alias("bits"))

    def bitmap_cardinality(self, filter: str | None = None) -> DataFrame:
        """One row, result: distinct members by bitmaps."""
        return self.bitmaps(filter).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("result"))
