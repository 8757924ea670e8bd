"""The mappings of the driver's tables to cells, as used by its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.cells import cells
from cohortlake.operators.queries import Engine

from .config import IndexConfig

EVENTS = """
apiVersion: v1
kind: IndexerConfig
metadata: {name: events-index}
source: {topic: events, bootstrap: none, consumerGroup: batch}
segmentation: {strategy: time, bucket: 1d, alignment: utc, retention: 30d, maxOpenSegments: 2}
fields:
  user: {path: user_id, type: int64}
  type: {path: event_type, type: string}
  k: {path: k, type: int64}
  kt: {path: k, type: string}
  value: {path: value, type: double}
  whole: {path: value, type: int64}
  ts: {path: ts, type: int64, unit: ms}
timeField: ts
member: {field: user, encoding: raw_uint32}
dimensions:
  - {name: event_type, field: type, encoding: dict}
  - {name: k, field: k, encoding: raw_uint32}
  - {name: vb, field: value, encoding: raw_uint32, bucket: {type: exponential, base: 2, min: 1, max: 65536}}
metrics:
  - {name: requestCount, type: count}
  - {name: totalValue, type: sum, field: whole}
  - {name: distinctUsers, type: ull, field: user, precision: 12}
  - {name: distinctK, type: ull, field: k, precision: 14, sliceBy: [event_type]}
storage: {path: events}
experimentalModels: {bsiDims: [], thetaSample: true, thetaSampleRate: 0.5, jointProfile: true, reorderMembers: true}
"""
JAN1, JAN31 = 1704067200000, 1706659200000
"""The days of the events table, in milliseconds."""
VRAW = "  - {name: vraw, field: whole, encoding: raw_uint32}\n"
ORDERS = """
apiVersion: v1
kind: IndexerConfig
metadata: {name: orders-index}
source: {topic: orders, bootstrap: none, consumerGroup: batch}
segmentation: {strategy: time, bucket: 30d}
fields:
  customer: {path: o_custkey, type: int64}
  status: {path: o_orderstatus, type: string}
  priority: {path: o_orderpriority, type: string}
  date: {path: o_orderdate, type: int64}
timeField: date
member: {field: customer, encoding: raw_uint32}
dimensions:
  - {name: status, field: status, encoding: dict}
  - {name: priority, field: priority, encoding: dict}
storage: {path: orders}
"""
LINEITEM = """
apiVersion: v1
kind: IndexerConfig
metadata: {name: lineitem-index}
source: {topic: lineitem, bootstrap: none, consumerGroup: batch}
segmentation: {strategy: time, bucket: 30d}
fields:
  supplier: {path: l_suppkey, type: int64}
  flag: {path: l_returnflag, type: string}
  status: {path: l_linestatus, type: string}
  quantity: {path: l_quantity, type: double}
  date: {path: l_shipdate, type: int64}
timeField: date
member: {field: supplier, encoding: raw_uint32}
dimensions:
  - {name: flag, field: flag, encoding: dict}
  - {name: lstatus, field: status, encoding: dict}
  - {name: qb, field: quantity, encoding: raw_uint32, bucket: {type: linear, step: 10, min: 0}}
storage: {path: lineitem}
"""


def with_k(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").try_cast("bigint"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_k(spark.read.parquet(f"{sf_dir}/events.parquet"))


def event_config(last_value: bool = False) -> IndexConfig:
    text = EVENTS
    if last_value:
        text = text.replace("metrics:\n", VRAW + "metrics:\n").replace("bsiDims: []", "bsiDims: [vraw]")
    return IndexConfig.parse(text)


def events(spark: SparkSession, sf_dir: str, last_value: bool = False) -> Engine:
    cfg = event_config(last_value)
    return Engine(cells(event_rows(spark, sf_dir), cfg, F.pmod("user_id", F.lit(4)), F.col("event_id")), cfg)


def orders(spark: SparkSession, sf_dir: str) -> Engine:
    cfg = IndexConfig.parse(ORDERS)
    return Engine(cells(spark.read.parquet(f"{sf_dir}/orders.parquet"), cfg, F.pmod("o_custkey", F.lit(4)), F.col("o_orderkey")), cfg)


def lineitem(spark: SparkSession, sf_dir: str) -> Engine:
    cfg = IndexConfig.parse(LINEITEM)
    return Engine(cells(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), cfg, F.pmod("l_suppkey", F.lit(4)), F.col("l_orderkey") * 8 + F.col("l_linenumber")), cfg)
