"""Pre-aggregated segments as Parquet, with a manifest that says which states of them are live.

Layout, under a root that all executors see:

- <table>/gen=<generation>/bucket=<ms>/: the tables of operators.segments
- manifest/v=<n>/: a row for each segment, with the generations that hold its state
- expired/ms=<time>/: how far retention has gone
- log/: what streams have taken (streaming.ingest)

A generation is written once and never changed. Writing, appending and compacting add one, and then a
new manifest, which is the commit; whoever reads goes on with the manifest that they began with.
Generations that the last KEPT manifests do not name are swept.

An open segment has a state for each append; freezing it merges them into one. Appending to a frozen
segment opens it again, so late records are kept. There is one writer; readers are not bounded.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.models import signatures
from cohortlake.operators.segments import TABLES, Stored, aggregated, catalog, merged, schemas
from cohortlake.plans.config import IndexConfig

KEPT = 3
# postings lie by dimension and value, so that a filter's leaves skip row groups
ORDER = {"totals": ["part"], "members": ["part", "member"], "postings": ["part", "dim", "value", "member"], "slices": ["part", "metric", "slices"]}


class Store:
    def __init__(self, spark: SparkSession, cfg: IndexConfig, root: str | None = None, kept: int = KEPT):
        self.spark, self.cfg, self.root, self.kept = spark, cfg, (root or cfg.storage.path).rstrip("/"), kept
        self.manifest_path = f"{self.root}/manifest"

    # files

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return bool(fs.exists(where))

    def names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    # manifests

    def versions(self) -> list[int]:
        """Versions of the manifest that were written whole, in order."""
        return sorted(int(n[2:]) for n in self.names(self.manifest_path) if n.startswith("v=") and self.exists(f"{self.manifest_path}/{n}/_SUCCESS"))

    def version(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.manifest_path}/v={n}")

    def manifest(self) -> DataFrame:
        """A row for each segment, as of the catalog, with frozen and gens, the generations that hold it."""
        known = self.versions()
        return self.version(known[-1]) if known else self.rebuild()

    def _save(self, manifest: DataFrame) -> DataFrame:
        new = 1 + max((int(n[2:]) for n in self.names(self.manifest_path) if n.startswith("v=")), default=0)
        manifest.orderBy("start_ms", "part", "id").coalesce(1).write.parquet(f"{self.manifest_path}/v={new}")
        self.sweep()
        return self.version(new)

    def _replace(self, rows: DataFrame, buckets: Iterable[int]) -> DataFrame:
        """A new manifest, in which rows stand for all segments of the buckets."""
        known = self.versions()
        if known:
            rows = self.version(known[-1]).where(~F.col("start_ms").isin(list(buckets))).unionByName(rows)
        return self._save(rows)

    def pruned_manifest(self, start: int | None = None, end: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        rows = self.manifest()
        rows = rows if end is None else rows.where(F.col("start_ms") < F.lit(end))
        rows = rows if start is None else rows.where(F.col("end_ms") > F.lit(start))
        parts = list(parts or [])
        return rows.where(F.col("part").isin(parts)) if parts else rows

    # states

    def _write(self, tables: Mapping[str, DataFrame], gen: str) -> None:
        """Files are ranges of a segment's rows, so a large segment is written by many tasks."""
        for name, rows in tables.items():
            order = ORDER[name]
            if name == "members" and "__order" in rows.columns:
                order = ["part", "__order", "member"]
            cut = rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).drop("__order")
            cut.write.mode("overwrite").option("compression", "zstd" if self.cfg.storage.compress == "zstd" else "none").partitionBy("bucket").parquet(f"{self.root}/{name}/gen={gen}")

    def _tables(self, live: Iterable[tuple[str, int]]) -> dict[str, DataFrame]:
        """The tables over the live (generation, bucket). What cannot be read is left out, with a warning where it is missing."""
        out, live = {}, sorted(live)
        for name, schema in schemas(self.cfg).items():
            base = f"{self.root}/{name}"
            paths = [f"{base}/gen={g}/bucket={b}" for g, b in live]
            found = [p for p in paths if self.exists(p)]
            if len(found) < len(paths) and name in ("totals", "members"):
                warnings.warn(f"{len(paths) - len(found)} states of {name} are missing", stacklevel=3)
            schema = schema.add("bucket", "long")
            if found:
                reader = self.spark.read.schema(schema.add("gen", "string")).option("basePath", base).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
                out[name] = reader.parquet(*found).drop("gen")
            else:
                out[name] = self.spark.createDataFrame([], schema)
        return out

    @staticmethod
    def _live(rows: DataFrame) -> tuple[list[tuple[str, int]], bool]:
        """(generation, bucket) pairs of a manifest's rows, and whether each segment has one; as many rows as segments come to the driver."""
        found = rows.select("start_ms", "gens").collect()
        return sorted({(g, r.start_ms) for r in found for g in r.gens}), all(len(r.gens) == 1 for r in found)

    def engine(self, start: int | None = None, end: int | None = None, version: int | None = None) -> Stored:
        """An engine over the segments of the last manifest or a given one, as they are now."""
        rows = self.manifest() if version is None else self.version(version)
        rows = rows if end is None else rows.where(F.col("start_ms") < F.lit(end))
        rows = rows if start is None else rows.where(F.col("end_ms") > F.lit(start))
        live, single = self._live(rows)
        tables = self._tables(live)
        return Stored(tables, self.cfg, single)

    def _listed(self, gens: DataFrame, frozen: bool) -> DataFrame:
        """Rows of a manifest for the segments (part, start_ms, gens)."""
        live, _ = self._live(gens)
        rows = catalog(self._tables(live), self.cfg)
        return rows.join(F.broadcast(gens), ["part", "start_ms"]).select(*rows.columns, F.lit(frozen).alias("frozen"), "gens")

    def _segments(self, tables: Mapping[str, DataFrame]) -> list[tuple[int, int]]:
        return [(r.part, r.bucket) for r in tables["totals"].select("part", "bucket").collect()]  # a row for each segment written

    def _gens(self, segments: Mapping[tuple[int, int], list[str]]) -> DataFrame:
        rows = [(p, b, g) for (p, b), g in segments.items()]
        return self.spark.createDataFrame(rows, "part int, start_ms long, gens array<string>")

    def write(self, cells: DataFrame, reorder: bool | None = None) -> DataFrame:
        """Puts the cells of whole buckets in the place of all that the store has of them. Returns the new manifest."""
        gen = f"w{uuid.uuid4().hex[:16]}"
        tables = aggregated(cells, self.cfg)
        if self.cfg.experimentalModels.reorderMembers if reorder is None else reorder:
            order = signatures(cells, self.cfg).select("part", "bucket", "member", F.xxhash64("signature").alias("__order"))
            tables["members"] = tables["members"].join(order, ["part", "bucket", "member"], "left")
        self._write(tables, gen)
        buckets = [int(n[7:]) for n in self.names(f"{self.root}/totals/gen={gen}") if n.startswith("bucket=")]
        if not buckets:
            return self.manifest() if self.versions() else self._save(self._empty(tables))
        written = self._segments(self._tables([(gen, b) for b in buckets]))
        return self._replace(self._listed(self._gens({s: [gen] for s in written}), True), buckets)

    def _empty(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        rows = catalog(tables, self.cfg).where("false")
        return rows.withColumns({"frozen": F.lit(True), "gens": F.array().cast("array<string>")})

    def append(self, cells: DataFrame, gen: str | None = None) -> DataFrame | None:
        """Adds the cells to their segments as a state of their own, which leaves them open. Once more with the same gen changes nothing."""
        gen = gen or f"a{uuid.uuid4().hex[:16]}"
        self._write(aggregated(cells, self.cfg), gen)
        buckets = [int(n[7:]) for n in self.names(f"{self.root}/totals/gen={gen}") if n.startswith("bucket=")]
        if not buckets:
            return None
        written = self._segments(self._tables([(gen, b) for b in buckets]))
        known = self.versions()
        before = self.version(known[-1]).where(F.col("start_ms").isin(buckets)).select("part", "start_ms", "gens").collect() if known else []
        gens = {(r.part, r.start_ms): list(r.gens) for r in before}
        for s in written:
            gens[s] = [*[g for g in gens.get(s, []) if g != gen], gen]
        return self._replace(self._listed(self._gens(gens), False), buckets)

    def freeze(self, before_ms: int | None = None) -> int:
        """Merges the states of every open segment whose bucket starts before a time, into one; returns how many segments that were."""
        if not self.versions():
            return 0
        rows = self.manifest()
        some = rows.where(~F.col("frozen")) if before_ms is None else rows.where(~F.col("frozen") & (F.col("start_ms") < F.lit(before_ms)))
        buckets = sorted({r.start_ms for r in some.select("start_ms").collect()})
        if not buckets:
            return 0
        opened = some.count()
        live, _ = self._live(rows.where(F.col("start_ms").isin(buckets)))
        gen = f"f{uuid.uuid4().hex[:16]}"
        self._write(merged(self._tables(live), self.cfg), gen)
        written = self._segments(self._tables([(gen, b) for b in buckets]))
        self._replace(self._listed(self._gens({s: [gen] for s in written}), True), buckets)
        return opened

    def roll(self, now_ms: int) -> int:
        """Freezes what is older than the buckets that may be open at a time."""
        width = self.cfg.bucket_ms
        return self.freeze(now_ms - now_ms % width - (self.cfg.segmentation.maxOpenSegments - 1) * width)

    def rebuild(self) -> DataFrame:
        """A manifest of the states that are there. Of written and frozen ones of a bucket the latest counts, and no append that is older than it."""
        base = f"{self.root}/totals"
        fs, _ = self._fs(base)
        found: dict[int, list[tuple[int, str]]] = {}
        for g in self.names(base):
            for b in self.names(f"{base}/{g}"):
                if g.startswith("gen=") and b.startswith("bucket="):
                    _, where = self._fs(f"{base}/{g}/{b}")
                    found.setdefault(int(b[7:]), []).append((fs.getFileStatus(where).getModificationTime(), g[4:]))
        live = []
        for bucket, states in found.items():
            states.sort()
            whole = max((i for i, (_, g) in enumerate(states) if g[0] in "wf"), default=0)
            live += [(g, bucket) for _, g in states[whole:]]
        if not live:
            raise FileNotFoundError(f"nothing is stored in {self.root}")
        tables = {g: self._segments(self._tables([(g, b) for x, b in live if x == g])) for g in {g for g, _ in live}}
        gens: dict[tuple[int, int], list[str]] = {}
        for g, _ in sorted(live, key=lambda x: x[0][0] not in "wf"):
            for s in tables[g]:
                if (g, s[1]) in live and g not in gens.setdefault(s, []):
                    gens[s].append(g)
        frozen = {s: g for s, g in gens.items() if len(g) == 1 and g[0][0] in "wf"}
        opened = {s: g for s, g in gens.items() if s not in frozen}
        rows = [self._listed(self._gens(x), f) for x, f in ((frozen, True), (opened, False)) if x]
        return self._save(rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1]))

    # retention

    def sweep(self) -> None:
        """Deletes manifests but the last, and the states that none of those names."""
        known = self.versions()
        kept = known[-self.kept :]
        if len(known) <= self.kept:
            return
        for n in known[: -self.kept]:
            self.delete(f"{self.manifest_path}/v={n}")
        named: dict[str, set[int]] = {}
        for n in kept:
            for g, b in self._live(self.version(n))[0]:
                named.setdefault(g, set()).add(b)
        first = self._committed(kept[0])
        for table in TABLES:
            for g in self.names(f"{self.root}/{table}"):
                path = f"{self.root}/{table}/{g}"
                fs, where = self._fs(path)
                if fs.getFileStatus(where).getModificationTime() >= first:
                    continue  # may be about to be named
                if g[4:] not in named:
                    self.delete(path)
                    continue
                for b in self.names(path):
                    if b.startswith("bucket=") and int(b[7:]) not in named[g[4:]]:
                        self.delete(f"{path}/{b}")

    def _committed(self, n: int) -> int:
        fs, where = self._fs(f"{self.manifest_path}/v={n}/_SUCCESS")
        return fs.getFileStatus(where).getModificationTime()

    def expired(self) -> int | None:
        """The time before which retention has deleted what had ended."""
        return max((int(n[3:]) for n in self.names(f"{self.root}/expired") if n.startswith("ms=")), default=None)

    def collect_garbage(self, now_ms: int, retention_ms: int | None = None) -> int:
        """Takes out buckets that ended before now - retention, and their log; returns how many. Late records for them are not taken any more."""
        keep = self.cfg.retention_ms if retention_ms is None else retention_ms
        if keep is None or not self.versions():
            return 0
        least = now_ms - keep
        old = {r.start_ms for r in self.manifest().where(F.col("end_ms") < F.lit(least)).select("start_ms").collect()}
        fs, where = self._fs(f"{self.root}/expired/ms={least}")
        fs.mkdirs(where)
        for batch in self.names(f"{self.root}/log"):
            for b in self.names(f"{self.root}/log/{batch}"):
                if b.startswith("bucket=") and int(b[7:]) + self.cfg.bucket_ms < least:
                    self.delete(f"{self.root}/log/{batch}/{b}")
        if old:
            self._save(self.manifest().where(~F.col("start_ms").isin(list(old))))
            for table in TABLES:
                for g in self.names(f"{self.root}/{table}"):
                    for b in old:
                        self.delete(f"{self.root}/{table}/{g}/bucket={b}")
        return len(old)
