"""Several nodes as one, in one plan. A node's segments are its own: a filter is evaluated on each, and the members that are found count once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.plans.config import IndexConfig

from .cells import SEGMENT
from .queries import Engine


class Federation:
    """Named nodes, of which some may be away; answers over the rest are partial."""

    def __init__(self, nodes: Mapping[str, DataFrame], cfg: IndexConfig, available: Iterable[str] | None = None):
        self.cfg = cfg
        up = set(nodes if available is None else available)
        self.up = {n: df for n, df in nodes.items() if n in up}
        self.down = [n for n in nodes if n not in up]
        if not self.up:
            raise ValueError("no node is available")
        # the node is part of a segment's key: one part and time of two nodes are two segments
        cells = reduce(DataFrame.unionByName, [df.withColumn("node", F.lit(n)) for n, df in self.up.items()])
        self.engine = Engine(cells, cfg, ("node", *SEGMENT))

    @property
    def partial(self) -> bool:
        return bool(self.down)

    def _flag(self, df: DataFrame) -> DataFrame:
        return df.withColumn("partial", F.lit(self.partial))

    def query(self, filter: str | None = None, agg: str = "count", **where) -> DataFrame:
        """One row as of Engine.query, with partial. Counts add up; members and sketches are merged."""
        return self._flag(self.engine.query(filter, agg, **where))

    def facets(self, filter: str | None = None, top: int = 20, **where) -> DataFrame:
        return self._flag(self.engine.facets(filter, top, **where))

    def timeseries(self, step: str, filter: str | None = None, agg: str = "count", **where) -> DataFrame:
        return self._flag(self.engine.timeseries(step, filter, agg, **where))

    def segments(self) -> DataFrame:
        return self.engine.segments()

    def nodes(self) -> DataFrame:
        """(node, up, segments, records) of all nodes; none are known of those away."""
        by = self.engine.cells.groupBy(*self.engine.keys).agg(F.count("*").alias("n"))
        rows = by.groupBy("node").agg(F.count("*").alias("segments"), F.sum("n").alias("records"))
        names = self.engine.cells.sparkSession.createDataFrame([(n, n in self.up) for n in [*self.up, *self.down]], "node string, up boolean")
        return names.join(F.broadcast(rows), "node", "left").select("node", "up", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("records", F.lit(0)).alias("records"))
