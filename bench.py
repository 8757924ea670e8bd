"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one line of JSON, seconds for each (median of warm runs).

The tables are written to a store of pre-aggregated segments first, which is what is asked, from the executors' memory. With
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortlake.operators.cells import cells
from cohortlake.operators.segments import Stored
from cohortlake.plans.config import IndexConfig
from cohortlake.plans.fixtures import JAN1, JAN31, events, lineitem, orders
from cohortlake.sources.decode import synthetic
from cohortlake.sources.store import Store

REQUESTS = """
apiVersion: v1
kind: IndexerConfig
metadata: {name: requests}
source: {topic: requests, bootstrap: none, consumerGroup: bench}
segmentation: {bucket: 1h}
fields:
  user: {path: userId, type: int64}
  country: {path: country, type: string}
  device: {path: device, type: string}
  os: {path: os, type: string}
  plan: {path: plan, type: string}
  status: {path: status, type: int64}
  latency: {path: latency, type: int64}
  at: {path: tsMs, type: int64}
timeField: at
member: {field: user, encoding: raw_uint32}
dimensions:
  - {name: country, field: country, encoding: dict}
  - {name: device, field: device, encoding: dict}
  - {name: os, field: os, encoding: dict}
  - {name: plan, field: plan, encoding: dict}
  - {name: status, field: status, encoding: raw_uint32}
metrics:
  - {name: requestCount, type: count}
  - {name: totalLatencyMs, type: sum, field: latency}
  - {name: distinctUsers, type: ull, field: user, precision: 12}
storage: {path: requests}
"""


def stored(spark: SparkSession, engine, root: str) -> Stored:
    store = Store(spark, engine.cfg, root)
    store.write(engine.cells)
    out = store.engine().persist()
    for table in out.tables.values():
        table.count()
    return out


def timed(queries: dict, runs: int) -> dict[str, list[float]]:
    seconds = {}
    for name, query in queries.items():
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            query().collect()
            taken.append(time.perf_counter() - began)
        seconds[name] = sorted(taken[1:])
    return seconds


def headline(spark: SparkSession, sf_dir: str, root: str) -> dict:
    e, o, li = (stored(spark, make(spark, sf_dir), f"{root}/{make.__name__}") for make in (events, orders, lineitem))
    e5 = "event_type:error"
    return {
        "all_members": lambda: e.query(None, "cardinality"),
        "and_two": lambda: e.query("event_type:purchase AND event_type:error", "cardinality"),
        "in_and_range": lambda: e.query("event_type:click,view AND k:[10,60]", "cardinality"),
        "in_two": lambda: e.query("event_type:purchase,signup", "cardinality"),
        "count_in": lambda: e.query("k:7,8,9,10", "count"),
        "and_not": lambda: e.query("event_type:click AND k:>50 AND NOT event_type:error", "cardinality"),
        "wide_in": lambda: e.query("k:0,1,2,3,4,5,6,7,8,9", "cardinality"),
        "not_count": lambda: e.query("NOT event_type:error", "count"),
        "sketch": lambda: e.query(None, "distinctUsers"),
        "sketch_filtered": lambda: e.query("event_type:click AND k:>50", "distinctUsers"),
        "sum_metric": lambda: e.query(None, "totalValue"),
        "sum_metric_filtered": lambda: e.query(e5, "totalValue"),
        "count_metric": lambda: e.query(e5, "requestCount"),
        "range_narrow": lambda: e.query("vb:[7,7]", "cardinality"),
        "range_wide": lambda: e.query("vb:[2,8]", "cardinality"),
        "facets": lambda: e.facets(e5, 10),
        "timeseries": lambda: e.timeseries("1d", e5, "cardinality", JAN1, JAN31),
        "orders_and": lambda: o.query("status:F AND status:O", "cardinality"),
        "lineitem_mixed": lambda: li.query("flag:R AND qb:>=3 AND NOT lstatus:O", "cardinality"),
    }


def requests(spark: SparkSession, rows: int, root: str) -> dict:
    from cohortlake.operators.queries import Engine

    cfg = IndexConfig.parse(REQUESTS)
    e = stored(spark, Engine(cells(synthetic(spark, rows), cfg, F.col("part"), F.col("offset")), cfg), f"{root}/requests")
    errors = "status:500,502,503,504"
    asked = {
        "all users": (None, "cardinality"),
        "US mobile": ("country:US AND device:mobile", "cardinality"),
        "IN+BR mobile": ("country:IN,BR AND device:mobile", "cardinality"),
        "pro+enterprise": ("plan:pro,enterprise", "cardinality"),
        "5xx errors": (errors, "count"),
        "mobile Android NOT free": ("device:mobile AND os:Android AND NOT plan:free", "cardinality"),
        "top-10 countries": ("country:US,IN,BR,DE,GB,FR,ID,MX,RU,JP", "cardinality"),
        "NOT errors global": (f"NOT {errors}", "count"),
        "distinctUsers": (None, "distinctUsers"),
        "distinctUsers mobile Android": ("device:mobile AND os:Android", "distinctUsers"),
        "totalLatencyMs all": (None, "totalLatencyMs"),
        "totalLatencyMs 5xx": (errors, "totalLatencyMs"),
        "requestCount enterprise": ("plan:enterprise", "requestCount"),
    }
    return {n: lambda f=f, a=a: e.query(f, a) for n, (f, a) in asked.items()}


def main() -> None:
    sf_dir, cpus, rows = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_ROWS", "0"))
    with tempfile.TemporaryDirectory(prefix="bench-") as root:  # one machine alone
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.warehouse.dir", f"{root}/warehouse")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        seconds = timed(requests(spark, rows, root) if rows else headline(spark, sf_dir, root), 10 if rows else 5)
        spark.stop()
    middle = {n: round(statistics.median(x), 4) for n, x in seconds.items()}
    line = {"metric": "seconds of all headline queries", "value": round(sum(middle.values()), 3), "unit": "sec", "queries": middle, "sf": sf_dir.rsplit("sf", 1)[-1]}
    if rows:
        line |= {"sf": f"{rows} records", "p90": {n: round(x[int(0.9 * (len(x) - 1))], 4) for n, x in seconds.items()}}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
