"""Pre-aggregated segments, which answer queries without the records that they were made of.

Tables, all by segment (part, bucket):

- totals: records, first and last offset, sum_<metric> and sketch_<metric>
- members: each member's records, whether it is inside the universe, and last_<dimension> with at_<dimension>, the offset of it
- postings: (dim, value, code, member), distinct
- slices: (metric, slices, sketch) of sliced metrics

A segment may have several states, of records that came at several times; they merge.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlake.plans.config import INTEGERS, Dimension, IndexConfig, Metric
from cohortlake.plans.filters import Always, Filter, Flags, holds, open_ended, ranges

from .cells import SEGMENT, listed, postings, pruned
from .queries import SKETCHES, Engine, in_universe
from .sketches import sketch, slices

TABLES = ("totals", "members", "postings", "slices")


def _plain(cfg: IndexConfig) -> list[Metric]:
    return [m for m in cfg.metrics if m.type in SKETCHES and not m.sliceBy]


def _sums(cfg: IndexConfig) -> list[Metric]:
    return [m for m in cfg.metrics if m.type == "sum"]


def schemas(cfg: IndexConfig) -> dict[str, T.StructType]:
    """Columns of the tables of a document, without the segment's bucket, which is where they lie."""
    kind = cfg.fields[cfg.member.field].type
    member = "bigint" if cfg.member.encoding != "dict" or kind in INTEGERS else {"bool": "boolean", "float": "double", "double": "double"}.get(kind, "string")
    last = "".join(f", last_{d} bigint, at_{d} bigint" for d in cfg.experimentalModels.bsiDims)
    totals = "".join(f", sum_{m.name} bigint" for m in _sums(cfg)) + "".join(f", sketch_{m.name} binary" for m in _plain(cfg))
    columns = {
        "totals": f"part int, records bigint, first_offset bigint, last_offset bigint{totals}",
        "members": f"part int, member {member}, records bigint, inside boolean{last}",
        "postings": f"part int, member {member}, dim string, value string, code bigint",
        "slices": "part int, metric string, slices array<string>, sketch binary",
    }
    return {n: T.StructType.fromDDL(c) for n, c in columns.items()}


def aggregated(cells: DataFrame, cfg: IndexConfig) -> dict[str, DataFrame]:
    """The tables of cells."""
    totals = cells.groupBy(*SEGMENT).agg(
        F.count("*").alias("records"),
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        *[F.coalesce(F.sum(F.col(f"field_{m.field}").cast("bigint")), F.lit(0)).alias(f"sum_{m.name}") for m in _sums(cfg)],
        *[F.hll_sketch_agg(F.col(f"field_{m.field}").cast("string"), F.lit(m.precision)).alias(f"sketch_{m.name}") for m in _plain(cfg)],
    )
    at = {d: F.when(F.col(f"raw_{d}").isNotNull(), F.col("offset")) for d in cfg.experimentalModels.bsiDims}
    last = [c for d, o in at.items() for c in (F.max_by(f"raw_{d}", o).alias(f"last_{d}"), F.max(o).alias(f"at_{d}"))]
    members = cells.groupBy(*SEGMENT, "member").agg(F.count("*").alias("records"), F.bool_or(in_universe(cfg)).alias("inside"), *last)
    cut = [sketch(cells, m).select(*SEGMENT, F.lit(m.name).alias("metric"), F.array(*[F.col(c).cast("string") for c in slices(m)]).alias("slices"), "sketch") for m in cfg.metrics if m.type in SKETCHES and m.sliceBy]
    out = {"totals": totals, "members": members, "postings": postings(cells, cfg)}
    return out | ({"slices": reduce(DataFrame.unionByName, cut)} if cut else {})


def merged(tables: Mapping[str, DataFrame], cfg: IndexConfig) -> dict[str, DataFrame]:
    """The tables with one state for each segment."""
    union = lambda c: F.hll_union_agg(c, F.lit(True)).alias(c)
    totals = tables["totals"].groupBy(*SEGMENT).agg(F.sum("records").alias("records"), F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"), *[F.sum(f"sum_{m.name}").alias(f"sum_{m.name}") for m in _sums(cfg)], *[union(f"sketch_{m.name}") for m in _plain(cfg)])
    last = [c for d in cfg.experimentalModels.bsiDims for c in (F.max_by(f"last_{d}", f"at_{d}").alias(f"last_{d}"), F.max(f"at_{d}").alias(f"at_{d}"))]
    members = tables["members"].groupBy(*SEGMENT, "member").agg(F.sum("records").alias("records"), F.bool_or("inside").alias("inside"), *last)
    out = {"totals": totals, "members": members, "postings": tables["postings"].distinct()}
    if "slices" in tables:
        out["slices"] = tables["slices"].groupBy(*SEGMENT, "metric", "slices").agg(union("sketch"))
    return out


def catalog(tables: Mapping[str, DataFrame], cfg: IndexConfig) -> DataFrame:
    """As cells.catalog, from merged or unmerged tables."""
    base = tables["totals"].groupBy(*SEGMENT).agg(F.sum("records").alias("records"), F.min("first_offset").alias("first_offset"), F.max("last_offset").alias("last_offset"))
    return listed(base, tables["postings"].select(*SEGMENT, "dim", "value"), cfg)


class Stored(Engine):
    """Queries over the tables of segments. single: each segment has one state, so nothing needs merging."""

    def __init__(self, tables: Mapping[str, DataFrame], cfg: IndexConfig, single: bool = False):
        super().__init__(None, cfg)
        self.tables, self.single = dict(tables), single

    def table(self, name: str, start: int | None = None, end: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        return pruned(self.tables[name], self.cfg, start, end, parts)

    @property
    def cells(self) -> DataFrame:
        """A cell for each posting and each member's last values: as far as sets of members go, the same as the records."""
        cfg, kinds = self.cfg, dict(self.tables["postings"].dtypes)
        own = lambda d: F.when(F.col("dim") == d.name, F.col("code") if d.numeric or d.hashed else F.col("value")).alias(f"dim_{d.name}")
        none = F.lit(None).cast("bigint")
        base = [*SEGMENT, "member"]
        held = self.tables["postings"].select(*base, none.alias("offset"), *[own(d) for d in cfg.dimensions], *[none.alias(f"raw_{d}") for d in cfg.experimentalModels.bsiDims])
        for dim in cfg.experimentalModels.bsiDims:
            nothing = [F.lit(None).cast("bigint" if d.numeric or d.hashed else kinds["value"]).alias(f"dim_{d.name}") for d in cfg.dimensions]
            raw = [(F.col(f"last_{d}") if d == dim else none).alias(f"raw_{d}") for d in cfg.experimentalModels.bsiDims]
            held = held.unionByName(self.tables["members"].where(F.col(f"at_{dim}").isNotNull()).select(*base, F.col(f"at_{dim}").alias("offset"), *nothing, *raw))
        return held

    def segments(self) -> DataFrame:
        return catalog(self.tables, self.cfg)

    def segment_keys(self, **where) -> DataFrame:
        return self.table("totals", **where).select(*SEGMENT).distinct()

    def _holds(self, leaf) -> Column | None:
        column: dict[str, Dimension] = {}

        def value(dim: Dimension) -> Column:
            column["dim"] = dim
            return F.col("code") if dim.numeric or dim.hashed else F.col("value")

        test = holds(self.cfg, leaf, value)
        return None if test is None else (F.col("dim") == column["dim"].name) & test

    def hits(self, tree: Filter, canonical: bool = False, keep_outside: bool = False, **where) -> DataFrame:
        members = self.table("members", **where)
        if isinstance(tree, Always):
            found = members.where("inside").select(*SEGMENT, "member")
            return found if self.single else found.distinct()
        by_last = frozenset() if canonical else frozenset(self.cfg.experimentalModels.bsiDims)
        flags = Flags(self._holds, lambda dim: F.max_by(f"last_{dim}", f"at_{dim}"), by_last)
        condition, asked = flags.condition(tree), [d for d in dict.fromkeys(ranges(tree)) if d in by_last]
        lasts = [f"{x}_{d}" for d in asked for x in ("last", "at")]
        none = F.lit(None)
        rows = self.table("postings", **where).where(flags.met()).select(*SEGMENT, "member", "dim", "value", "code", F.lit(True).alias("inside"), *[none.cast("bigint").alias(c) for c in lasts])
        if asked or open_ended(tree):  # all members, too
            rest = members if not asked or open_ended(tree) else members.where(reduce(lambda a, b: a | b, [F.col(f"at_{d}").isNotNull() for d in asked]))
            rows = rows.unionByName(rest.select(*SEGMENT, "member", none.cast("string").alias("dim"), none.cast("string").alias("value"), none.cast("bigint").alias("code"), "inside", *lasts))
        inside = F.lit(True) if keep_outside and asked else F.bool_or("inside")
        grouped = rows.groupBy(*SEGMENT, "member").agg(inside.alias("inside"), *[c.alias(n) for n, c in flags.aggregates.items()])
        return grouped.where(condition & F.col("inside")).select(*SEGMENT, "member")

    def held(self, **where) -> DataFrame:
        rows = self.table("postings", **where).select(*SEGMENT, "member", "dim", "value")
        return rows if self.single else rows.distinct()

    def summed(self, metric: Metric, **where) -> DataFrame:
        n = "records" if metric.type == "count" else f"sum_{metric.name}"
        rows = self.table("totals", **where)
        return rows.select(*SEGMENT, F.col(n).alias("n")) if self.single else rows.groupBy(*SEGMENT).agg(F.sum(n).alias("n"))

    def sketches(self, metric: Metric, **where) -> DataFrame:
        by = slices(metric)
        if not by:
            rows = self.table("totals", **where).select(*SEGMENT, F.col(f"sketch_{metric.name}").alias("sketch"))
        else:
            kinds = ["bigint" if d.numeric or d.hashed else "string" for d in (self.cfg.dimension(s) for s in metric.sliceBy)]
            rows = self.table("slices", **where).where(F.col("metric") == metric.name).select(*SEGMENT, *[F.col("slices")[i].cast(k).alias(c) for i, (c, k) in enumerate(zip(by, kinds, strict=True))], "sketch")
        return rows if self.single else rows.groupBy(*SEGMENT, *by).agg(F.hll_union_agg("sketch", F.lit(True)).alias("sketch"))

    def weights(self, **where) -> DataFrame:
        rows = self.table("members", **where).select(*SEGMENT, "member", "records")
        return rows if self.single else rows.groupBy(*SEGMENT, "member").agg(F.sum("records").alias("records"))

    def persist(self) -> Stored:
        """The same engine with its tables in the executors' memory, as far as it reaches.

        Members lie together, so that no query shuffles but for its last sums, and postings in order of value, so that leaves skip batches.
        """
        order = {"members": ["part", "bucket", "member"], "postings": ["dim", "value"]}
        kept = {n: t.repartition("member").sortWithinPartitions(*order[n]) if n in order else t.coalesce(1) for n, t in self.tables.items()}
        return Stored({n: t.persist() for n, t in kept.items()}, self.cfg, self.single)

    def unpersist(self) -> None:
        for t in self.tables.values():
            t.unpersist()
