"""Streams of records into a store, each record once.

Every micro-batch is deduplicated on (part, offset) and held against the log of what other batches
took of its buckets; what is new is written to the log and appended to the store, both under the
batch's own name, so a batch that is run once more after a crash writes the same again. A batch
reads two columns of the log of the buckets that it touches, and writes no more than it brings.
Late records open their segment again; those of buckets that retention has taken are dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.sources.store import Store

Indexer = Callable[[DataFrame], DataFrame]


class Ingest:
    """index turns a batch of records into cells. With roll, each batch freezes what is older than the buckets that may be open at its latest event."""

    def __init__(self, store: Store, index: Indexer, roll: bool = True):
        self.store, self.index, self.roll, self.log_path, self.run = store, index, roll, f"{store.root}/log", uuid.uuid4().hex[:8]
        self.query = None

    def batch(self, records: DataFrame, batch_id: int | None = None) -> None:
        name = f"{self.run}-{batch_id if batch_id is not None else uuid.uuid4().hex[:8]}"
        cells = self.index(records).dropDuplicates(["part", "offset"])
        gone = self.store.expired()
        if gone is not None:
            cells = cells.where(F.col("bucket") + F.lit(self.store.cfg.bucket_ms) >= F.lit(gone))
        cells = cells.persist()
        try:
            range_ = cells.agg(F.collect_set("bucket").alias("buckets"), F.max("ts_ms").alias("latest")).first()  # as many as buckets in one batch
            if not range_.buckets:
                return
            new, seen = cells, self._seen(range_.buckets, name)
            if seen is not None:
                new = cells.join(seen, ["part", "offset", "bucket"], "left_anti").select(*cells.columns)
            log = f"{self.log_path}/{name}"
            new.write.mode("overwrite").partitionBy("bucket").parquet(log)
            if not any(n.startswith("bucket=") for n in self.store.names(log)):
                return
            taken = self.store.spark.read.parquet(log).withColumn("bucket", F.col("bucket").cast("bigint")).select(*cells.columns)
            self.store.append(taken, f"s{name}")
            if self.roll:
                self.store.roll(range_.latest)
        finally:
            cells.unpersist()

    def _seen(self, buckets: list[int], name: str) -> DataFrame | None:
        """(part, offset, bucket) that other batches took of the buckets."""
        paths = [f"{self.log_path}/{b}/bucket={x}" for b in self.store.names(self.log_path) if b != name for x in buckets]
        paths = [p for p in paths if self.store.exists(p)]
        if not paths:
            return None
        where = F.regexp_extract(F.col("_metadata.file_path"), "bucket=(-?[0-9]+)", 1).cast("bigint")
        return self.store.spark.read.parquet(*paths).select("part", "offset", where.alias("bucket"))

    def start(self, stream: DataFrame, checkpoint: str, once: bool = True):
        """A streaming query; with once, all that is there is taken and the query ends. Its batches are named by its checkpoint."""
        self.run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        self.query = (writer.trigger(availableNow=True) if once else writer).start()
        return self.query

    def stop(self) -> int:
        """Ends the stream once what it has begun is taken, and freezes all that is open; returns how many segments that were."""
        if self.query is not None:
            if self.query.isActive:
                self.query.processAllAvailable()
            self.query.stop()
        return self.store.freeze()


def open_segments(records: DataFrame, bucket: str, late: str, *by: str) -> DataFrame:
    """A stream by tumbling event-time windows of bucket and of member numbers (b), which close late after their end (ts: timestamp).

    A bitmap holds the members of one b alone, so the members of a window are the sum of its bitmaps' counts.
    """
    keys = [F.window("ts", bucket), *by, F.bitmap_bucket_number("member").alias("b")]
    return records.withWatermark("ts", late).groupBy(*keys).agg(F.count("*").alias("records"), F.bitmap_construct_agg(F.bitmap_bit_position("member")).alias("members"))
