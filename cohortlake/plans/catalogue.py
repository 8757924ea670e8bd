"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions import encoders
from cohortlake.functions.coerce import coerce, event_ms
from cohortlake.operators import models
from cohortlake.operators.cells import cells, dimension_cardinality, overflow_counts
from cohortlake.operators.federate import Federation
from cohortlake.operators.queries import Engine
from cohortlake.operators.segments import Stored
from cohortlake.sources.api import handle
from cohortlake.sources.scratch import scratch
from cohortlake.sources.store import Store
from cohortlake.streaming.ingest import Ingest, open_segments

from .config import Bucket, ConfigError, Dimension, IndexConfig
from .fixtures import EVENTS, JAN1, JAN31, event_config, event_rows, events, lineitem, orders, with_k

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FILTERS: dict[str, tuple] = {}
"""The filters that are asked of the events and of a store of them."""
DAY = 86_400_000
JAN5_6H, JAN6_6H = 1704434400000, 1704520800000

CELLS = """
c AS (SELECT CAST(user_id % 4 AS INTEGER) AS part, epoch_ms(ts) - epoch_ms(ts) % 86400000 AS bucket, event_id AS "offset", epoch_ms(ts) AS ts_ms, user_id AS member, event_type,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(trunc(value) AS BIGINT) AS vraw, value,
      CASE WHEN value <= 1 THEN 0 ELSE CAST(floor(ln(least(value, 65536)) / ln(2.0)) AS BIGINT) + 1 END AS vb FROM events)"""


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _hits(flags: dict[str, str], condition: str, result: str = "count(DISTINCT CASE WHEN hit THEN member END)", metric: str = "cardinality", where: str = "true", cells: str = CELLS) -> str:
    """The canonical form: a flag of each leaf for every member of a segment, then a condition over the flags."""
    leaves = "".join(f", coalesce(bool_or({sql}), false) AS {name}" for name, sql in flags.items())
    return f"""WITH {cells}, m AS (SELECT part, bucket, member{leaves} FROM c WHERE {where} GROUP BY part, bucket, member), h AS (SELECT *, ({condition}) AS hit FROM m)
SELECT count(DISTINCT (part, bucket)) AS segments, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS matched, {result} AS result, '{metric}' AS metric, false AS approx FROM h"""


def _filter(name: str, text: str | None, flags: dict[str, str], condition: str, agg: str = "cardinality", where: str = "true", engine=events, cells: str = CELLS, **limits) -> None:
    result = "count(DISTINCT CASE WHEN hit THEN member END)" if agg != "count" else "CAST(count(*) FILTER (WHERE hit) AS BIGINT)"
    if engine is events:
        FILTERS[name] = (text, agg, limits)
    _register(name, lambda s, d: engine(s, d).query(text, agg, **limits), _hits(flags, condition, result, agg, where, cells))


# filters and exact aggregates
_p, _e, _c, _v, _s = ({x[0]: f"event_type = '{x}'"} for x in ("purchase", "error", "click", "view", "signup"))
_filter("card_all", None, {}, "true")
_filter("card_eq", "event_type:purchase", _p, "p")
_filter("card_in", "event_type:click,view", _c | _v, "c OR v")
_filter("card_and", "event_type:purchase AND event_type:error", _p | _e, "p AND e")
_filter("card_or_not", "(event_type:click OR event_type:signup) AND NOT event_type:error", _c | _s | _e, "(c OR s) AND NOT e")
_filter("card_not", "NOT event_type:purchase", _p, "NOT p")
_filter("card_precedence", 'event_type:click or event_type:view and not event_type:"error"', _c | _v | _e, "c OR (v AND NOT e)")
_filter("card_gt", "k:>90", {"l": "k > 90"}, "l")
_filter("card_ge", "k:>=90", {"l": "k >= 90"}, "l")
_filter("card_lt", "k:<5", {"l": "k < 5"}, "l")
_filter("card_le", "k:<=5", {"l": "k <= 5"}, "l")
_filter("card_range", "k:[10,20]", {"l": "k BETWEEN 10 AND 20"}, "l")
_filter("card_number_in", "k:7,8,x", {"l": "k IN (7, 8)"}, "l")
_filter("card_unknown_dim", "nothing:1 OR event_type:error", _e, "e")
_filter("card_unknown_value", "event_type:none", {}, "false")
_filter("card_range_on_dict", "event_type:[1,2]", {}, "false")
_filter("count_builtin", "event_type:purchase AND event_type:error", _p | _e, "p AND e", agg="count")
_filter("time_prune_overlap", None, {}, "true", where=f"bucket < {JAN6_6H} AND bucket + 86400000 > {JAN5_6H}", start=JAN5_6H, end=JAN6_6H)
_filter("partition_subset", "event_type:purchase", _p, "p", where="part IN (0, 1)", parts=[0, 1])
_filter("bucket_range_canonical", "vb:>=8", {"l": "vb >= 8"}, "l")
_filter("metric_ull_filtered_exact", "event_type:purchase", _p, "p", agg="distinctUsers")
_register("metric_count", lambda s, d: events(s, d).query("event_type:error", "requestCount"), f"WITH {CELLS} SELECT count(DISTINCT (part, bucket)) AS segments, count(*) AS matched, count(*) AS result, 'requestCount' AS metric, false AS approx FROM c")
_register("metric_sum", lambda s, d: events(s, d).query("event_type:error", "totalValue"), f"WITH {CELLS} SELECT count(DISTINCT (part, bucket)) AS segments, CAST(sum(vraw) AS BIGINT) AS matched, CAST(sum(vraw) AS BIGINT) AS result, 'totalValue' AS metric, false AS approx FROM c")
_register("matched_records", lambda s, d: events(s, d).records("event_type:purchase AND event_type:error"), f"""WITH {CELLS}, m AS (SELECT part, bucket, member FROM c GROUP BY ALL HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'error'))
SELECT count(*) AS records FROM c SEMI JOIN m USING (part, bucket, member)""")

# approximate aggregates, within a tolerance of the exact
_register("metric_ull_nofilter_tol", lambda s, d: _near(events(s, d).query(None, "distinctUsers").select("segments", F.col("result").alias("estimate")), events(s, d).query(None, "cardinality").select("result")), f"WITH {CELLS} SELECT count(DISTINCT (part, bucket)) AS segments, true AS close FROM c")


def _near(estimate: DataFrame, exact: DataFrame) -> DataFrame:
    both = estimate.withColumn("one", F.lit(1)).join(exact.withColumn("one", F.lit(1)), "one")
    return both.select("segments", (F.abs(F.col("estimate") / F.col("result") - 1) < 0.05).alias("close"))


def _sliced(s: SparkSession, d: str, engine: Engine | None = None) -> DataFrame:
    exact = events(s, d).cells.groupBy("dim_event_type").agg(F.count_distinct("field_k").alias("exact"))
    both = (engine or events(s, d)).sliced("distinctK").join(exact, "dim_event_type")
    return both.select(F.col("dim_event_type").alias("event_type"), (F.abs(F.col("estimate") / F.col("exact") - 1) < 0.05).alias("close"))


_register("sliced_ull_tol", _sliced, "SELECT event_type, true AS close FROM events GROUP BY event_type")
_register("bitmap_cardinality", lambda s, d: events(s, d).bitmap_cardinality("event_type:purchase"), f"WITH {CELLS} SELECT count(DISTINCT member) AS result FROM c WHERE event_type = 'purchase'")


# buckets
def _buckets(spec: Bucket) -> Query:
    return lambda s, d: event_rows(s, d).groupBy(encoders.bucketed(F.col("value"), spec).alias("bucket")).agg(F.count("*").alias("n"))


_register("bucket_linear", _buckets(Bucket("linear", step=25.0, min=10.0, max=400.0)), "SELECT CAST(floor((least(greatest(value, 10), 400) - 10) / 25) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
_register("bucket_exponential", _buckets(Bucket("exponential", base=2.0, min=1.0, max=65536.0)), f"WITH {CELLS} SELECT CAST(vb AS BIGINT) AS bucket, count(*) AS n FROM c GROUP BY 1")
_register("bucket_explicit", _buckets(Bucket("explicit", boundaries=[1.0, 10.0, 50.0, 100.0, 500.0])), "SELECT CAST((value >= 1)::INT + (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT + (value >= 500)::INT AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
_register("raw_uint32_range", lambda s, d: event_rows(s, d).select(encoders.uint32(F.col("event_id") * 3_000_000 - 1_000_000).alias("id")).agg(F.count("id").alias("n"), F.max("id").alias("most")), "SELECT count(*) AS n, max(x) AS most FROM (SELECT event_id * 3000000 - 1000000 AS x FROM events) WHERE x BETWEEN 0 AND 4294967295")
_register("hash_fold", lambda s, d: event_rows(s, d).select(encoders.folded_hash(F.col("event_type")).alias("h"), "event_type").agg(F.count_distinct("h").alias("codes"), (F.min("h") >= 0).alias("positive"), (F.max("h") < F.lit(1 << 32)).alias("fits")), "SELECT count(DISTINCT event_type) AS codes, true AS positive, true AS fits FROM events")
_register("overflow_guard", lambda s, d: overflow_counts(events(s, d).cells, Dimension("k", "k", "raw_uint32", maxCardinality=50)).agg(F.sum("accepted").alias("accepted"), F.sum("overflowed").alias("overflowed")), f"""WITH {CELLS}, f AS (SELECT part, bucket, k, min("offset") AS first FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part, bucket ORDER BY first, k) AS nth FROM f)
SELECT CAST(count(*) FILTER (WHERE nth <= 50) AS BIGINT) AS accepted, CAST(count(*) FILTER (WHERE nth > 50) AS BIGINT) AS overflowed FROM r""")

# facets, time series, catalog
_POSTINGS = "p AS (SELECT DISTINCT part, bucket, member, 'event_type' AS dim, event_type AS value FROM c UNION SELECT DISTINCT part, bucket, member, 'k', CAST(k AS VARCHAR) FROM c UNION SELECT DISTINCT part, bucket, member, 'vb', CAST(vb AS VARCHAR) FROM c)"
_TOP = "SELECT dim, value, count FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY count DESC, value) AS place FROM n) WHERE place <= {}"
_register("facets_all", lambda s, d: events(s, d).facets(), f"WITH {CELLS}, {_POSTINGS}, n AS (SELECT dim, value, count(*) AS count FROM p GROUP BY ALL) " + _TOP.format(20))
_register("facets_filtered_topn", lambda s, d: events(s, d).facets("event_type:error", 3), f"WITH {CELLS}, {_POSTINGS}, e AS (SELECT DISTINCT part, bucket, member FROM c WHERE event_type = 'error'), n AS (SELECT dim, value, count(*) AS count FROM p SEMI JOIN e USING (part, bucket, member) GROUP BY ALL) " + _TOP.format(3))


def _series(name: str, step: str, ms: int, text: str | None, agg: str, test: str, result: str, start: int = JAN1, end: int = JAN31) -> None:
    sql = f"""WITH {CELLS}, s AS (SELECT {start} + i * {ms} AS step_start, least({start} + (i + 1) * {ms}, {end}) AS step_end FROM range({-(-(end - start) // ms)}) t(i)),
m AS (SELECT part, bucket, member, bool_or({test}) AS hit FROM c GROUP BY ALL)
SELECT step_start, step_end, CAST({result} AS BIGINT) AS result FROM s LEFT JOIN m ON m.hit AND m.bucket < step_end AND m.bucket + 86400000 > step_start GROUP BY ALL"""
    _register(name, lambda s, d: events(s, d).timeseries(step, text, agg, start, end), sql)


_series("timeseries_1d", "1d", DAY, "event_type:purchase", "cardinality", "event_type = 'purchase'", "count(DISTINCT member)")
_series("timeseries_6h_overlap", "6h", DAY // 4, None, "count", "true", "count(member)")
_series("timeseries_1h", "1h", DAY // 24, "k:>50", "cardinality", "k > 50", "count(DISTINCT member)", JAN5_6H, JAN6_6H + 1_800_000)
_register("timeseries_metric", lambda s, d: events(s, d).timeseries("1d", None, "totalValue", JAN1, JAN31), f"WITH {CELLS} SELECT {JAN1} + i * 86400000 AS step_start, {JAN1} + (i + 1) * 86400000 AS step_end, CAST(coalesce(sum(vraw), 0) AS BIGINT) AS result FROM range(30) t(i) LEFT JOIN c ON bucket = {JAN1} + i * 86400000 GROUP BY i")
_register("legacy_cardinality", lambda s, d: events(s, d).legacy_cardinality("event_type", "click"), f"WITH {CELLS} SELECT count(DISTINCT (part, bucket, member)) AS result FROM c WHERE event_type = 'click'")
_register("segments_catalog", lambda s, d: events(s, d).segments(), f"""WITH {CELLS} SELECT 'p-' || part || '-' || bucket AS id, part, bucket AS start_ms, bucket + 86400000 AS end_ms, count(*) AS records, min("offset") AS first_offset, max("offset") AS last_offset,
count(DISTINCT event_type) AS values_event_type, count(DISTINCT k) AS values_k, count(DISTINCT vb) AS values_vb FROM c GROUP BY part, bucket""")
_register("dimension_cardinality", lambda s, d: dimension_cardinality(events(s, d).cells, events(s, d).cfg), f"WITH {CELLS} SELECT 'event_type' AS dim, count(DISTINCT event_type) AS values FROM c UNION ALL SELECT 'k', count(DISTINCT k) FROM c UNION ALL SELECT 'vb', count(DISTINCT vb) FROM c")

# models
_LAST = "l AS (SELECT part, bucket, member, arg_max(vraw, \"offset\") AS v FROM c WHERE vraw BETWEEN 0 AND 4294967295 GROUP BY ALL)"
last = lambda s, d: events(s, d, last_value=True)
_register("bsi_range", lambda s, d: last(s, d).query("vraw:[100,200]", "cardinality").select("matched", "result"), f"WITH {CELLS}, {_LAST} SELECT count(*) AS matched, count(DISTINCT member) AS result FROM l WHERE v BETWEEN 100 AND 200")
_register("bsi_mixed", lambda s, d: last(s, d).query("event_type:purchase AND vraw:[100,200]", "cardinality").select("matched", "result"), f"WITH {CELLS}, {_LAST}, m AS (SELECT DISTINCT part, bucket, member FROM c WHERE event_type = 'purchase') SELECT count(*) AS matched, count(DISTINCT member) AS result FROM l JOIN m USING (part, bucket, member) WHERE v BETWEEN 100 AND 200")
_register("bsi_eq", lambda s, d: models.last_value_count(last(s, d).cells, "vraw", 50, 50), f"WITH {CELLS}, {_LAST} SELECT count(*) AS matched, count(DISTINCT member) AS result FROM l WHERE v = 50")
_register("bsi_lt", lambda s, d: models.last_value_count(last(s, d).cells, "vraw", None, 9), f"WITH {CELLS}, {_LAST} SELECT count(*) AS matched, count(DISTINCT member) AS result FROM l WHERE v < 10")
_register("bsi_sum", lambda s, d: models.last_value_sum(last(s, d), "vraw", "event_type:purchase"), f"WITH {CELLS}, {_LAST}, m AS (SELECT DISTINCT part, bucket, member FROM c WHERE event_type = 'purchase') SELECT CAST(sum(v) AS BIGINT) AS result FROM l JOIN m USING (part, bucket, member)")
_SAMPLE = "CAST(('0x' || substr(md5(CAST(member AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"
for _name, _rate, _text, _test in (("theta_half", 0.5, "event_type:purchase", "event_type = 'purchase'"), ("theta_sixteenth", 0.0625, None, "true")):
    _register(_name, lambda s, d, t=_text, r=_rate: models.theta_estimate(events(s, d), t, r), f"WITH {CELLS} SELECT count(DISTINCT member) AS sample, CAST(floor(count(DISTINCT member) / {_rate}) AS BIGINT) AS result FROM c WHERE {_test} AND {_SAMPLE} < {_rate}")
_register("joint_profile_card", lambda s, d: models.profile_count(events(s, d), "event_type:purchase AND NOT k:7"), f"WITH {CELLS}, m AS (SELECT part, bucket, member FROM c GROUP BY ALL HAVING bool_or(event_type = 'purchase') AND NOT bool_or(k = 7)) SELECT count(*) AS matched, count(DISTINCT member) AS result FROM m")


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    shown = models.profiles(events(s, d).cells.withColumns({"dim_k": F.lit(None).cast("bigint"), "dim_vb": F.lit(None).cast("bigint")}), events(s, d).cfg)
    return shown.groupBy(F.array_join(F.transform("signature", lambda a: a["value"]), ",").alias("signature")).agg(F.count("*").alias("profiles"), F.sum("members").alias("members"))


_register("joint_profile_dictionary", _dictionary, f"""WITH {CELLS}, m AS (SELECT part, bucket, member, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS signature FROM c GROUP BY ALL), p AS (SELECT part, bucket, signature, count(*) AS n FROM m GROUP BY ALL)
SELECT signature, count(*) AS profiles, CAST(sum(n) AS BIGINT) AS members FROM p GROUP BY signature""")
_register("reordered_card", lambda s, d: models.reordered_count(events(s, d), "event_type:click,view"), f"WITH {CELLS} SELECT count(DISTINCT (part, bucket, member)) AS matched, count(DISTINCT member) AS result FROM c WHERE event_type IN ('click', 'view')")
_register("member_permutation", lambda s, d: models.permutation(events(s, d).cells, events(s, d).cfg).groupBy("part", "bucket").agg(F.count("*").alias("members"), F.count_distinct("position").alias("positions"), F.max("position").cast("bigint").alias("last")), f"WITH {CELLS} SELECT part, bucket, count(DISTINCT member) AS members, count(DISTINCT member) AS positions, count(DISTINCT member) - 1 AS last FROM c GROUP BY ALL")
_register("compare_models", lambda s, d: models.compare(events(s, d), "roaring,bsi,theta,joint_profile,reordered,unknown", "event_type:purchase"), f"""WITH {CELLS}, n AS (SELECT CAST(count(DISTINCT member) AS DOUBLE) AS v, CAST(floor(count(DISTINCT CASE WHEN {_SAMPLE} < 0.5 THEN member END) / 0.5) AS DOUBLE) AS t FROM c WHERE event_type = 'purchase')
SELECT unnest(['roaring', 'bsi', 'theta', 'joint_profile', 'reordered']) AS model, true AS supported, unnest([v, v, t, v, v]) AS value, unnest([false, false, true, false, false]) AS approx, CAST(NULL AS VARCHAR) AS error FROM n""")
_register("compare_models_range", lambda s, d: models.compare(events(s, d), "ROARING,bsi,joint_profile", "k:[10,20]", "count"), f"""WITH {CELLS}, n AS (SELECT CAST(count(DISTINCT (part, bucket, member)) AS DOUBLE) AS v FROM c WHERE k BETWEEN 10 AND 20)
SELECT unnest(['roaring', 'bsi', 'joint_profile']) AS model, unnest([true, false, false]) AS supported, unnest([v, NULL, NULL]) AS value, false AS approx, unnest([NULL, 'missing BSI for dim(s): k', 'joint_profile has no ranges']) AS error FROM n""")


# nodes
def _nodes(s: SparkSession, d: str) -> Federation:
    e = events(s, d)
    return Federation({f"node{i}": e.cells.where(f"part % 2 = {i}") for i in (0, 1)}, e.cfg)


_register("fanout_cardinality", lambda s, d: _nodes(s, d).query("event_type:purchase", "cardinality"), f"WITH {CELLS} SELECT (SELECT count(DISTINCT (part, bucket)) FROM c) AS segments, count(DISTINCT (part, bucket, member)) AS matched, count(DISTINCT member) AS result, 'cardinality' AS metric, false AS approx, false AS partial FROM c WHERE event_type = 'purchase'")
_register("fanout_count", lambda s, d: _nodes(s, d).query("event_type:purchase", "count"), f"WITH {CELLS} SELECT (SELECT count(DISTINCT (part, bucket)) FROM c) AS segments, count(DISTINCT (part, bucket, member)) AS matched, count(DISTINCT (part, bucket, member)) AS result, 'count' AS metric, false AS approx, false AS partial FROM c WHERE event_type = 'purchase'")
_register("fanout_facets", lambda s, d: _nodes(s, d).facets("event_type:error", 5), f"WITH {CELLS}, {_POSTINGS}, e AS (SELECT DISTINCT part, bucket, member FROM c WHERE event_type = 'error'), n AS (SELECT dim, value, count(*) AS count FROM p SEMI JOIN e USING (part, bucket, member) GROUP BY ALL) " + _TOP.format(5).replace("SELECT dim, value, count FROM", "SELECT dim, value, count, false AS partial FROM"))
_register("fanout_segments", lambda s, d: _nodes(s, d).segments().select("node", "part", "start_ms", "records"), f"WITH {CELLS} SELECT 'node' || (part % 2) AS node, part, bucket AS start_ms, count(*) AS records FROM c GROUP BY part, bucket")
_register("fanout_nodes", lambda s, d: _nodes(s, d).nodes(), f"WITH {CELLS} SELECT 'node' || (part % 2) AS node, true AS up, count(DISTINCT (part, bucket)) AS segments, count(*) AS records FROM c GROUP BY 1")
_register("fanout_partial", lambda s, d: Federation({f"node{i}": events(s, d).cells.where(f"part % 2 = {i}") for i in (0, 1)}, events(s, d).cfg, ["node0"]).query(None, "cardinality"), f"WITH {CELLS} SELECT count(DISTINCT (part, bucket)) AS segments, count(DISTINCT (part, bucket, member)) AS matched, count(DISTINCT member) AS result, 'cardinality' AS metric, false AS approx, true AS partial FROM c WHERE part % 2 = 0")


# nodes that have the same parts and times: a node's segments are its own
def _shared(s: SparkSession, d: str) -> Federation:
    e = events(s, d)
    return Federation({f"node{i}": e.cells.where(f"offset % 2 = {i}") for i in (0, 1)}, e.cfg)


def _shared_hits(flags: dict[str, str], condition: str, result: str, agg: str) -> str:
    leaves = "".join(f", coalesce(bool_or({sql}), false) AS {name}" for name, sql in flags.items())
    return f"""WITH {CELLS}, m AS (SELECT "offset" % 2 AS node, part, bucket, member{leaves} FROM c GROUP BY ALL), h AS (SELECT *, ({condition}) AS hit FROM m)
SELECT count(DISTINCT (node, part, bucket)) AS segments, CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS matched, {result} AS result, '{agg}' AS metric, false AS approx, false AS partial FROM h"""


_HIT_MEMBERS, _HIT_PAIRS = "count(DISTINCT CASE WHEN hit THEN member END)", "CAST(count(*) FILTER (WHERE hit) AS BIGINT)"
_register("fanout_shared_and", lambda s, d: _shared(s, d).query("event_type:purchase AND event_type:click", "cardinality"), _shared_hits(_p | _c, "p AND c", _HIT_MEMBERS, "cardinality"))
_register("fanout_shared_not", lambda s, d: _shared(s, d).query("NOT event_type:purchase", "count"), _shared_hits(_p, "NOT p", _HIT_PAIRS, "count"))
_register("fanout_timeseries", lambda s, d: _shared(s, d).timeseries("1d", "event_type:purchase AND event_type:click", "cardinality", start=JAN1, end=JAN31), f"""WITH {CELLS}, m AS (SELECT "offset" % 2 AS node, part, bucket, member FROM c GROUP BY ALL HAVING bool_or(event_type = 'purchase') AND bool_or(event_type = 'click'))
SELECT {JAN1} + i * 86400000 AS step_start, {JAN1} + (i + 1) * 86400000 AS step_end, count(DISTINCT member) AS result, false AS partial FROM range(30) t(i) LEFT JOIN m ON bucket = {JAN1} + i * 86400000 GROUP BY i""")
_register("fanout_sketch", lambda s, d: _near(_shared(s, d).query(None, "distinctUsers").select("segments", F.col("result").alias("estimate")), events(s, d).query(None, "cardinality").select("result")), f"""WITH {CELLS} SELECT count(DISTINCT ("offset" % 2, part, bucket)) AS segments, true AS close FROM c""")
_register("fanout_shared_facets", lambda s, d: _shared(s, d).facets(None, 5), f"WITH {CELLS.replace('AS member, event_type', 'AS member, event_id % 2 AS node, event_type')}, {_POSTINGS.replace('DISTINCT part', 'DISTINCT node, part')}, n AS (SELECT dim, value, count(*) AS count FROM p GROUP BY ALL) " + _TOP.format(5).replace("SELECT dim, value, count FROM", "SELECT dim, value, count, false AS partial FROM"))


# store and stream
_STORES: dict[tuple, Store] = {}


def _stored(s: SparkSession, d: str, last_value: bool = False) -> Store:
    """The events as segments of a store, written once in a session: half of them as a whole, the rest appended, which leaves segments open."""
    key = (s.sparkContext.applicationId, d, last_value)
    if key not in _STORES:
        engine = events(s, d, last_value)
        store = Store(s, engine.cfg, scratch(s))
        store.write(engine.cells.where("offset % 2 = 0"))
        store.append(engine.cells.where("offset % 2 = 1"))
        _STORES[key] = store
    return _STORES[key]


def _frozen(s: SparkSession, d: str) -> Stored:
    store = _stored(s, d)
    store.freeze()
    return store.engine()


def _kept(s: SparkSession, d: str) -> DataFrame:
    engine = events(s, d)
    store = Store(s, engine.cfg, scratch(s))
    store.write(engine.cells)
    store.collect_garbage(now_ms=JAN31, retention_ms=10 * DAY)
    return store.manifest().select("part", "start_ms", "records")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The stream's answers, after every record has come in micro-batches and half of them once more."""
    cfg, root = event_config(), scratch(s)
    rows = s.read.parquet(f"{d}/events.parquet")
    ingest = Ingest(Store(s, cfg, f"{root}/store"), lambda raw: cells(with_k(raw), cfg, F.pmod("user_id", F.lit(4)), F.col("event_id")))
    rows.where("event_id % 2 = 0").write.parquet(f"{root}/in/a.parquet")
    rows.write.parquet(f"{root}/in/b.parquet")
    files = sum(n.startswith("part-") for n in ingest.store.names(f"{root}/in/a.parquet"))  # a folder is a batch, however many files Spark makes of it
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, files)).parquet(f"{root}/in/*.parquet")
    ingest.start(stream, f"{root}/checkpoint").awaitTermination()
    engine = ingest.store.engine()
    asked = [engine.query("event_type:purchase AND event_type:error", "cardinality"), engine.query(None, "requestCount"), engine.query(None, "totalValue")]
    return reduce(DataFrame.unionByName, asked)


_register("store_query", lambda s, d: _stored(s, d).engine().query("event_type:purchase", "cardinality"), ORACLE_SQL["card_eq"])
for _name, (_text, _agg, _limits) in FILTERS.items():
    _register(f"store_{_name}", lambda s, d, t=_text, a=_agg, w=_limits: _stored(s, d).engine().query(t, a, **w), ORACLE_SQL[_name])
_register("store_frozen", lambda s, d: _frozen(s, d).query("NOT event_type:purchase", "cardinality"), ORACLE_SQL["card_not"])
_register("store_metric_count", lambda s, d: _stored(s, d).engine().query("event_type:error", "requestCount"), ORACLE_SQL["metric_count"])
_register("store_metric_sum", lambda s, d: _stored(s, d).engine().query("event_type:error", "totalValue"), ORACLE_SQL["metric_sum"])
_register("store_matched_records", lambda s, d: _stored(s, d).engine().records("event_type:purchase AND event_type:error"), ORACLE_SQL["matched_records"])
_register("store_metric_ull_nofilter_tol", lambda s, d: _near(_stored(s, d).engine().query(None, "distinctUsers").select("segments", F.col("result").alias("estimate")), _stored(s, d).engine().query(None, "cardinality").select("result")), ORACLE_SQL["metric_ull_nofilter_tol"])
_register("store_sliced_ull_tol", lambda s, d: _sliced(s, d, _stored(s, d).engine()), ORACLE_SQL["sliced_ull_tol"])
_register("store_facets_all", lambda s, d: _stored(s, d).engine().facets(), ORACLE_SQL["facets_all"])
_register("store_facets_filtered_topn", lambda s, d: _stored(s, d).engine().facets("event_type:error", 3), ORACLE_SQL["facets_filtered_topn"])
_register("store_timeseries_1d", lambda s, d: _stored(s, d).engine().timeseries("1d", "event_type:purchase", "cardinality", JAN1, JAN31), ORACLE_SQL["timeseries_1d"])
_register("store_timeseries_metric", lambda s, d: _stored(s, d).engine().timeseries("1d", None, "totalValue", JAN1, JAN31), ORACLE_SQL["timeseries_metric"])
_register("store_segments_catalog", lambda s, d: _stored(s, d).engine().segments(), ORACLE_SQL["segments_catalog"])
_register("store_legacy_cardinality", lambda s, d: _stored(s, d).engine().legacy_cardinality("event_type", "click"), ORACLE_SQL["legacy_cardinality"])
_register("store_bsi_mixed", lambda s, d: _stored(s, d, True).engine().query("event_type:purchase AND vraw:[100,200]", "cardinality").select("matched", "result"), ORACLE_SQL["bsi_mixed"])
_register("store_compare_models", lambda s, d: models.compare(_stored(s, d).engine(), "roaring,bsi,theta,joint_profile,reordered,unknown", "event_type:purchase"), ORACLE_SQL["compare_models"])


def _open_and_frozen(s: SparkSession, d: str) -> DataFrame:
    """Which segments a roll at noon of the last day freezes, after all came as appends."""
    engine = events(s, d)
    store = Store(s, engine.cfg, scratch(s))
    store.append(engine.cells.where(f"bucket < {JAN6_6H}"))
    store.append(engine.cells)  # the first days once more, so they have two states
    store.roll(JAN31 - DAY // 2)
    return store.manifest().select("part", "start_ms", "records", "frozen", F.size("gens").alias("states"))


_register("store_rolled", _open_and_frozen, f"""WITH {CELLS} SELECT part, bucket AS start_ms, count(*) * CASE WHEN bucket < {JAN6_6H} THEN 2 ELSE 1 END AS records, bucket < {JAN31 - 2 * DAY} AS frozen, 1 AS states FROM c GROUP BY part, bucket""")
_register("store_snapshot", lambda s, d: _snapshot(s, d).query("event_type:purchase", "count"), _hits(_p, "p", "CAST(count(*) FILTER (WHERE hit) AS BIGINT)", "count", where='"offset" % 2 = 0'))


def _snapshot(s: SparkSession, d: str) -> Stored:
    """A reader that began before more came in."""
    engine = events(s, d)
    store = Store(s, engine.cfg, scratch(s))
    store.write(engine.cells.where("offset % 2 = 0"))
    reader = store.engine()
    store.append(engine.cells.where("offset % 2 = 1"))
    store.freeze()
    return reader


_register("manifest_prune", lambda s, d: _stored(s, d).pruned_manifest(JAN5_6H, JAN6_6H).select("part", "start_ms", "records"), f"WITH {CELLS} SELECT part, bucket AS start_ms, count(*) AS records FROM c WHERE bucket < {JAN6_6H} AND bucket + 86400000 > {JAN5_6H} GROUP BY part, bucket")
_register("gc_keep", _kept, f"WITH {CELLS} SELECT part, bucket AS start_ms, count(*) AS records FROM c WHERE bucket + 86400000 >= {JAN31 - 10 * DAY} GROUP BY part, bucket")
_register("stream_equals_batch", _streamed, f"({ORACLE_SQL['card_and']}) UNION ALL ({ORACLE_SQL['metric_count']}) UNION ALL ({ORACLE_SQL['metric_sum']})")


def _open(s: SparkSession, d: str) -> DataFrame:
    """Closed windows of a stream of members far apart, as bitmaps by bucket of member numbers."""
    root = scratch(s)
    last = F.lit(JAN31 + 30 * DAY)  # a later record closes all windows
    rows = s.read.parquet(f"{d}/events.parquet").select(F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), (F.col("user_id") * 40_000).alias("member"))
    rows.write.parquet(f"{root}/in/1")
    rows.limit(1).select(F.timestamp_millis(last).alias("ts"), F.lit(0).cast("long").alias("member")).write.parquet(f"{root}/in/2")
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/in/*")
    closed = open_segments(stream, "1 day", "1 day").select(F.unix_millis("window.start").alias("start_ms"), "b", "records", "members")
    closed.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{root}/out").groupBy("start_ms").agg(F.sum("records").alias("records"), F.sum(F.bitmap_count("members")).alias("members"))


_register("stream_open_segments", _open, f"WITH {CELLS} SELECT bucket AS start_ms, CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT member) AS BIGINT) AS members FROM c GROUP BY bucket")


# extraction
def _json(s: SparkSession, d: str) -> DataFrame:
    """Events as JSON texts with nested fields, one in seven of them no JSON."""
    rows = s.read.parquet(f"{d}/events.parquet")
    value = F.to_json(F.struct(F.struct("user_id", F.struct(F.col("event_type").alias("kind")).alias("about")).alias("who"), F.col("value").cast("string").alias("amount"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at")))
    return rows.select("user_id", "event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("no "), value)).otherwise(value).alias("value"))


NESTED = IndexConfig.parse("""
apiVersion: v1
kind: IndexerConfig
metadata: {name: nested}
source: {topic: t, bootstrap: none, consumerGroup: g}
segmentation: {bucket: 1d}
fields:
  user: {path: who.user_id, type: int64}
  kind: {path: who.about.kind, type: string}
  amount: {path: amount, type: string}
  absent: {path: who.nothing.here, type: string}
  at: {path: at, type: int64}
timeField: at
member: {field: user, encoding: raw_uint32}
dimensions:
  - {name: kind, field: kind, encoding: dict}
  - {name: band, field: amount, encoding: raw_uint32, bucket: {type: linear, step: 25}}
  - {name: absent, field: absent, encoding: dict}
metrics: [{name: n, type: count}]
storage: {path: nested}
""")


def _nested(s: SparkSession, d: str) -> Engine:
    return Engine(cells(_json(s, d), NESTED, F.pmod("user_id", F.lit(4)), F.col("event_id"), json="value"), NESTED)


_NESTED = CELLS.replace("FROM events)", "FROM events WHERE event_id % 7 <> 0)")
_register("json_decode", lambda s, d: _nested(s, d).cells.select("offset", "bucket", "member", F.col("dim_kind").alias("kind"), F.col("dim_absent").isNull().alias("absent")), f"""WITH {_NESTED} SELECT "offset", bucket, member, event_type AS kind, true AS absent FROM c""")
_register("dotted_path", lambda s, d: _nested(s, d).query("kind:purchase AND NOT kind:error", "cardinality"), _hits(_p | _e, "p AND NOT e", cells=_NESTED))
_register("bucket_text_input", lambda s, d: _nested(s, d).facets(None, 5).where("dim = 'band'"), f"WITH {_NESTED}, p AS (SELECT DISTINCT part, bucket, member, 'band' AS dim, CAST(CAST(floor(greatest(value, 0) / 25) AS BIGINT) AS VARCHAR) AS value FROM c), n AS (SELECT dim, value, count(*) AS count FROM p GROUP BY ALL) " + _TOP.format(5))


def _edited(s: SparkSession, d: str, old: str, new: str, **columns) -> Engine:
    """The events under a document with one line changed, and with columns replaced."""
    cfg = IndexConfig.parse(EVENTS.replace(old, new))
    return Engine(cells(event_rows(s, d).withColumns(columns), cfg, F.pmod("event_id", F.lit(4)), F.col("event_id")), cfg)


_EDITED = CELLS.replace("user_id % 4", "event_id % 4")
_register("null_members", lambda s, d: _edited(s, d, "\n", "\n", user_id=F.when(F.col("event_id") % 3 != 0, F.col("user_id"))).query(None, "requestCount"), f"""WITH {_EDITED} SELECT count(DISTINCT (part, bucket)) AS segments, count(*) AS matched, count(*) AS result, 'requestCount' AS metric, false AS approx FROM c WHERE "offset" % 3 <> 0""")
_register("hash_dims", lambda s, d: _edited(s, d, "field: type, encoding: dict", "field: type, encoding: hash64, hashAlgo: xxh3").query("event_type:click,view AND NOT event_type:error", "count"), _hits(_c | _v | _e, "(c OR v) AND NOT e", "CAST(count(*) FILTER (WHERE hit) AS BIGINT)", "count", cells=_EDITED))
_register("hash_members", lambda s, d: _edited(s, d, "field: user, encoding: raw_uint32", "field: user, encoding: hash64").query("event_type:click", "cardinality"), _hits(_c, "c", cells=_EDITED))
for _kind in ("hll", "cpc"):
    _register(f"{_kind}_tol", lambda s, d, k=_kind: _near((e := _edited(s, d, "name: distinctUsers, type: ull", f"name: distinctUsers, type: {k}")).query(None, "distinctUsers").select("segments", F.col("result").alias("estimate")), e.query(None, "cardinality").select("result")), f"WITH {_EDITED} SELECT count(DISTINCT (part, bucket)) AS segments, true AS close FROM c")
_GUARDED = """f AS (SELECT part, bucket, k, min("offset") AS first FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part, bucket ORDER BY first, k) AS nth FROM f),
g AS (SELECT c.part, c.bucket, c.member, CASE WHEN nth <= 20 THEN {} ELSE {} END AS value FROM c JOIN r USING (part, bucket, k))"""
_register("guarded_values", lambda s, d: _edited(s, d, "name: k, field: k, encoding: raw_uint32", "name: k, field: k, encoding: raw_uint32, maxCardinality: 20").query("k:[10,60]", "count"), f"WITH {_EDITED}, {_GUARDED.format('k', 'NULL')} SELECT (SELECT count(DISTINCT (part, bucket)) FROM c) AS segments, count(DISTINCT (part, bucket, member)) AS matched, count(DISTINCT (part, bucket, member)) AS result, 'count' AS metric, false AS approx FROM g WHERE value BETWEEN 10 AND 60")
_register("guarded_overflow", lambda s, d: _edited(s, d, "name: k, field: k, encoding: raw_uint32", "name: k, field: kt, encoding: dict, maxCardinality: 20, onOverflow: overflow").query("k:__overflow__", "count"), f"WITH {_EDITED}, {_GUARDED.format('NULL', 'k')} SELECT (SELECT count(DISTINCT (part, bucket)) FROM c) AS segments, count(DISTINCT (part, bucket, member)) AS matched, count(DISTINCT (part, bucket, member)) AS result, 'count' AS metric, false AS approx FROM g WHERE value IS NOT NULL")
_register("guarded_members", lambda s, d: _edited(s, d, "member: {field: user, encoding: raw_uint32}", "member: {field: user, encoding: dict, dict: {maxSize: 2}}").query(None, "requestCount"), f"""WITH {_EDITED}, f AS (SELECT part, bucket, member, min("offset") AS first FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part, bucket ORDER BY first, member) AS nth FROM f)
SELECT count(DISTINCT (part, bucket)) AS segments, count(*) AS matched, count(*) AS result, 'requestCount' AS metric, false AS approx FROM c JOIN r USING (part, bucket, member) WHERE nth <= 2""")
REQUESTS = (
    ("/health", {}, 200), ("/query", {"filter": "event_type:"}, 400), ("/query", {"filter": "event_type:click)"}, 400), ("/query", {"filter": "k:[1,x]"}, 400), ("/query", {"agg": "nothing"}, 400),
    ("/query", {"filter": "event_type:click", "agg": "distinctK"}, 400), ("/query", {"from": "2024-01-05T06:00:00", "to": "2024-01-06T06:00:00Z"}, 200), ("/internal/query", {"agg": "distinctUsers"}, 200),
    ("/timeseries", {"bucketSize": "2h"}, 400), ("/cardinality", {"dim": "event_type"}, 400), ("/nodes", {}, 200), ("/none", {}, 404),
)


def _statuses(s: SparkSession, d: str) -> DataFrame:
    rows = [(i, path, handle(events(s, d), path, params)[0]) for i, (path, params, _) in enumerate(REQUESTS)]
    few = Engine(events(s, d).cells, IndexConfig.parse(EVENTS + "query: {maxSegmentsPerQuery: 3}\n"))
    return s.createDataFrame([*rows, (len(rows), "/query", handle(few, "/query", {})[0])], "n int, path string, status int")


_register("api_statuses", _statuses, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{path}', {status})" for i, (path, status) in enumerate([*((p, c) for p, _, c in REQUESTS), ("/query", 400)])) + ") t(n, path, status)")
FAULTY = (
    ("bucket: 1d", "bucket: 1x", "segmentation.bucket"), ("{field: user, encoding", "{field: nobody, encoding", "member.field"), ("name: events-index", "name: E", "metadata.name"),
    ("field: k, precision: 14", "field: k, precision: 3", "metric distinctK"), ("timeField: ts", "timeField: no", "timeField"), ("sliceBy: [event_type]", "sliceBy: [none]", "metric distinctK"), ("thetaSampleRate: 0.5", "thetaSampleRate: 2", "experimentalModels.thetaSampleRate"),
)


def _faults(s: SparkSession, d: str) -> DataFrame:
    rows = []
    for i, (old, new, _) in enumerate(FAULTY):
        try:
            IndexConfig.parse(EVENTS.replace(old, new), validate=True)
        except ConfigError as e:
            rows += [(i, x.split(":")[0]) for x in e.errors]
    return s.createDataFrame(rows, "n int, place string")


_register("config_faults", _faults, "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{place}')" for i, (_, _, place) in enumerate(FAULTY)) + ") t(n, place)")
_register("timeseries_defaults", lambda s, d: events(s, d).timeseries("6h", "event_type:purchase"), f"""WITH {CELLS}, b AS (SELECT min(bucket) AS lo, max(bucket) + 86400000 AS hi FROM c), s AS (SELECT lo + i * 21600000 AS step_start, lo + (i + 1) * 21600000 AS step_end FROM b, range(10000) t(i) WHERE lo + i * 21600000 < hi),
m AS (SELECT DISTINCT part, bucket, member FROM c WHERE event_type = 'purchase')
SELECT step_start, step_end, count(member) AS result FROM s LEFT JOIN m ON m.bucket < step_end AND m.bucket + 86400000 > step_start GROUP BY ALL""")


def _coerced(s: SparkSession, d: str) -> DataFrame:
    rows = event_rows(s, d)
    text, number = rows.schema["props"].dataType, rows.schema["value"].dataType
    piece = F.get_json_object("props", "$.k")
    return rows.select("event_id", coerce(piece, text, "int64").alias("k"), coerce(F.concat(F.lit(" "), piece), text, "int64").isNull().alias("blank"), coerce(F.col("value"), number, "int32").alias("whole"), coerce(F.col("value"), number, "bool").alias("truth"), coerce(F.col("event_type"), text, "double").isNull().alias("none"))


_register("extract_coerce", _coerced, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS blank, CAST(trunc(value) AS BIGINT) AS whole, value <> 0 AS truth, true AS none FROM events")
_register("time_units", lambda s, d: event_rows(s, d).select("event_id", *[event_ms(F.col("event_id") * 1_000_003, event_rows(s, d).schema["event_id"].dataType, u, F.lit(0)).alias(u) for u in ("ms", "us", "ns", "s")]), "SELECT event_id, event_id * 1000003 AS ms, event_id * 1000003 // 1000 AS us, event_id * 1000003 // 1000000 AS ns, event_id * 1000003000 AS s FROM events")

# other tables
_ORDERS = "c AS (SELECT CAST(o_custkey % 4 AS INTEGER) AS part, epoch_ms(o_orderdate) - epoch_ms(o_orderdate) % 2592000000 AS bucket, o_custkey AS member, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
_LINEITEM = "c AS (SELECT CAST(l_suppkey % 4 AS INTEGER) AS part, epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % 2592000000 AS bucket, l_suppkey AS member, l_returnflag AS flag, l_linestatus AS lstatus, CAST(floor(l_quantity / 10) AS BIGINT) AS qb FROM lineitem)"
_filter("orders_card_all", None, {}, "true", engine=orders, cells=_ORDERS)
_filter("orders_card_and", "status:F AND status:O", {"f": "status = 'F'", "o": "status = 'O'"}, "f AND o", engine=orders, cells=_ORDERS)
_filter("orders_card_quoted", 'priority:"1-URGENT","2-HIGH" AND NOT status:F', {"u": "priority IN ('1-URGENT', '2-HIGH')", "f": "status = 'F'"}, "u AND NOT f", engine=orders, cells=_ORDERS)
_filter("lineitem_card_mixed", "flag:R AND qb:>=3 AND NOT lstatus:O", {"r": "flag = 'R'", "q": "qb >= 3", "o": "lstatus = 'O'"}, "r AND q AND NOT o", engine=lineitem, cells=_LINEITEM)
_filter("lineitem_card_range", "qb:[1,2] OR flag:N", {"n": "flag = 'N'", "q": "qb BETWEEN 1 AND 2"}, "q OR n", engine=lineitem, cells=_LINEITEM)

__all__ = ["ORACLE_SQL", "QUERIES", "Engine"]
