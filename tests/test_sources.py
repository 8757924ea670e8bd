import json

import pytest
from pyspark.sql import functions as F

from cohortlake.__main__ import main
from cohortlake.operators import models
from cohortlake.operators.cells import cells
from cohortlake.plans import catalogue
from cohortlake.plans.config import IndexConfig
from cohortlake.plans.filters import parse
from cohortlake.plans.fixtures import EVENTS
from cohortlake.sources import decode, schemas
from cohortlake.sources.api import Coordinator, handle, instant, parts
from cohortlake.sources.store import Store
from cohortlake.streaming.ingest import Ingest
from test_engine import CFG, CONFIG, engine, one

HOUR = 3_600_000
ROWS = [(u % 2, u, "FR" if u % 3 else "DE", "mobile", u, (u % 4) * HOUR) for u in range(40)]


def answers(e, brief=False):
    """What an engine says to a query of every kind, or of some."""
    sort = lambda df: sorted(map(str, df.collect()))
    out = {}
    for text in (None, "country:FR AND device:mobile", "latencyMs:>5 AND NOT country:DE", "country:DE OR NOT latencyMs:<9"):
        out[text] = sort(e.query(text, "cardinality")) + sort(e.query(text, "count", canonical=True, start=HOUR, end=2 * HOUR + 1, parts=[1]))
    if brief:
        return out
    text = "latencyMs:[3,30]"
    out["facets"], out["records"] = sort(e.facets(None, 3)) + sort(e.facets(text, 3)), sort(e.records("country:FR"))
    out["series"] = sort(e.timeseries("1h", text, "cardinality")) + sort(e.timeseries("6h", None, "totalLatency"))
    out["models"] = sort(models.compare(e, "bsi,joint_profile,reordered", "NOT country:FR")) + sort(models.last_value_sum(e, "latencyMs"))
    for agg in ("requestCount", "totalLatency", "distinctUsers", "distinctCountries"):
        out[agg] = sort(e.query(None, agg))
    out["sliced"] = sort(e.sliced("distinctBySlice"))
    out["rest"] = sort(e.segments()) + sort(e.bitmap_cardinality("country:FR")) + [e.guard(start=HOUR)]
    return out


SLICED = IndexConfig.parse(CONFIG.replace("storage:", "  - {name: distinctBySlice, type: ull, field: userId, precision: 12, sliceBy: [country, latencyMs]}\nstorage:"))
MIXED = [*ROWS, *[(u % 2, u, "DE" if u % 5 else None, "desktop", 40 - u, (u % 3) * HOUR) for u in range(0, 40, 3)], (0, 99, None, None, 5, 0), (0, 98, None, None, None, HOUR)]


def test_store_answers_as_the_records_do(spark, tmp_path):
    e = engine(spark, MIXED, SLICED)
    want = answers(e)
    parts = Store(spark, SLICED, f"{tmp_path}/appended")
    for k in (0, 1, 1):  # once more changes nothing
        parts.append(e.cells.where(f"offset % 2 = {k}"), f"s{k}")
    opened = parts.engine()
    assert not opened.single and answers(opened) == want
    assert parts.manifest().where("frozen").count() == 0 and parts.freeze() == e.segments().count()
    frozen = parts.engine()
    assert frozen.single and answers(frozen, brief=True).items() <= want.items() and parts.freeze() == 0
    held = frozen.persist()
    assert held.query("country:FR OR NOT device:mobile", "cardinality").collect() == e.query("country:FR OR NOT device:mobile", "cardinality").collect()
    assert "Exchange" not in held.hits(parse("country:FR AND device:mobile")).groupBy("member").count()._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    held.unpersist()
    plan = frozen.hits(parse("country:FR"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(dim,country), EqualTo(value,FR)" in plan


def test_store_and_manifest(spark, tmp_path):
    e = engine(spark, ROWS)
    store = Store(spark, CFG, str(tmp_path))
    store.write(e.cells)
    store.write(e.cells)  # once more changes nothing
    assert store.manifest().drop("gens", "frozen").collect() == sorted(e.segments().collect(), key=lambda r: (r.start_ms, r.part))
    assert store.pruned_manifest(HOUR, 2 * HOUR).count() == e.cells.where(f"bucket = {HOUR}").select("part").distinct().count()
    store.append(e.cells.where("offset < 5"), "late")
    before = sorted(map(str, store.engine().segments().collect()))
    assert store.rebuild().where("NOT frozen").count() == store.manifest().where("size(gens) > 1").count() > 0
    assert sorted(map(str, store.engine().segments().collect())) == before
    store.write(e.cells)
    some = store.engine(HOUR, 2 * HOUR)
    assert all(f"bucket={HOUR}" in f for t in some.tables.values() for f in t.inputFiles())
    assert store.collect_garbage(now_ms=4 * HOUR, retention_ms=HOUR) == 2
    assert store.manifest().agg(F.min("start_ms")).first()[0] == 2 * HOUR
    assert store.engine().segment_keys().agg(F.min("bucket")).first()[0] == 2 * HOUR and store.expired() == 3 * HOUR
    store.write(e.cells.where("false"))
    assert store.manifest().count() == 2


def test_readers_go_on_while_the_store_changes(spark, tmp_path):
    e = engine(spark, ROWS)
    store = Store(spark, CFG, str(tmp_path))
    store.append(e.cells.where("offset < 20"), "s1")
    reader = store.engine()
    store.append(e.cells.where("offset >= 20"), "s2")
    store.freeze()
    assert one(reader.query(None, "requestCount")) == 20 and one(store.engine().query(None, "requestCount")) == 40
    assert one(store.engine(version=1).query(None, "requestCount")) == 20
    for k in range(4):  # states that no kept manifest names are swept
        store.append(e.cells.where("offset = 0"), f"x{k}")
    assert len(store.versions()) == store.kept
    assert "gen=s1" not in store.names(f"{store.root}/totals")


def test_states_that_cannot_be_read_are_left_out(spark, tmp_path):
    import shutil

    e = engine(spark, ROWS)
    store = Store(spark, CFG, str(tmp_path))
    store.write(e.cells)
    gen = store.manifest().first().gens[0]
    shutil.rmtree(tmp_path / "totals" / f"gen={gen}" / f"bucket={HOUR}")
    for f in (tmp_path / "totals" / f"gen={gen}" / f"bucket={2 * HOUR}").glob("*.parquet"):
        f.write_bytes(b"no parquet")
        f.with_name(f".{f.name}.crc").unlink()
    with pytest.warns(UserWarning, match="missing"):
        got = store.engine()
    assert one(got.query(None, "requestCount")) == 20


def test_stream_equals_batch(spark, tmp_path):
    lines = [json.dumps({"part": p, "offset": i, "user": {"id": u}, "country": c, "device": d, "ms": m, "ts": t}) for i, (p, u, c, d, m, t) in enumerate(ROWS)]
    source = tmp_path / "in"
    source.mkdir()
    for n, chunk in enumerate((lines[30:], lines[:20], lines[10:30])):  # late records, and ten twice
        (source / f"{n}.json").write_text("\n".join(chunk) + "\nnot json\n")

    def index(raw):
        where = F.from_json("value", "part int, offset long")
        return cells(raw, CFG, where["part"], where["offset"], json="value")

    store = Store(spark, CFG, str(tmp_path / "store"))
    ingest = Ingest(store, index)
    ingest.start(decode.json_files(spark, str(source), streaming=True), str(tmp_path / "checkpoint")).awaitTermination()
    batch = engine(spark, ROWS)
    for text, agg in (("country:FR AND device:mobile", "cardinality"), (None, "requestCount"), (None, "totalLatency"), (None, "count")):
        assert one(store.engine().query(text, agg)) == one(batch.query(text, agg))
    ingest.batch(decode.json_files(spark, str(source)))  # a replay
    assert one(store.engine().query(None, "requestCount")) == len(ROWS)
    assert answers_are_equal(store, batch)
    ingest.stop()
    assert store.manifest().where("NOT frozen").count() == 0 and answers_are_equal(store, batch)


def answers_are_equal(store, batch):
    return all(store.engine().query(t, a).first() == batch.query(t, a).first() for t in (None, "NOT country:FR", "latencyMs:[3,9]") for a in ("count", "cardinality"))


def test_batches_that_are_run_again(spark, tmp_path):
    """A crash after the log, or after the state, was written: the batch is run once more under its name."""
    rows = engine(spark, ROWS).cells
    store = Store(spark, CFG, str(tmp_path))
    ingest = Ingest(store, lambda df: df, roll=False)
    ingest.batch(rows.where("offset < 10"), 0)
    real, store.append = store.append, lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        ingest.batch(rows.where("offset BETWEEN 5 AND 25"), 1)
    store.append = real
    ingest.batch(rows.where("offset BETWEEN 5 AND 25"), 1)
    ingest.batch(rows.where("offset BETWEEN 5 AND 25"), 1)
    assert one(store.engine().query(None, "requestCount")) == 26
    ingest.batch(rows, 2)
    assert one(store.engine().query(None, "requestCount")) == 40
    assert store.engine().cells.count() and {len(r.gens) for r in store.manifest().collect()} == {3}


def test_rolling_and_retention(spark, tmp_path):
    rows = engine(spark, ROWS).cells
    store = Store(spark, CFG, str(tmp_path))
    ingest = Ingest(store, lambda df: df)
    for hour in range(4):
        ingest.batch(rows.where(f"bucket = {hour * HOUR}"))
    by = {r.start_ms // HOUR: r.frozen for r in store.manifest().collect()}
    assert by == {0: True, 1: True, 2: False, 3: False}  # two buckets may be open
    ingest.batch(rows.where("bucket = 0").limit(2).withColumn("offset", F.col("offset") + 1000))  # late
    assert one(store.engine().query(None, "requestCount")) == 42
    assert store.collect_garbage(4 * HOUR, HOUR) == 2
    assert all(f"bucket={h * HOUR}" not in store.names(f"{store.root}/log/{n}") for n in store.names(f"{store.root}/log") for h in (0, 1))
    ingest.batch(rows.withColumn("offset", F.col("offset") + 2000))  # the first two hours are over for good
    assert store.manifest().agg(F.min("start_ms")).first()[0] == 2 * HOUR
    assert ingest.stop() == 2 and store.manifest().where("NOT frozen").count() == 0


def test_coordinator(spark):
    """A node and two peers with the same parts and times, one of which goes away."""
    import urllib.parse

    from test_engine import FILTERS, brute, random_rows

    nodes = [random_rows(20 + i, 50) for i in range(3)]
    engines = [engine(spark, rows) for rows in nodes]
    away = set()

    def fetch(url):
        at = urllib.parse.urlsplit(url)
        n = int(at.netloc[-1])
        if n in away:
            raise OSError("away")
        status, body = handle(engines[n], at.path, dict(urllib.parse.parse_qsl(at.query)))
        assert status == 200
        return json.loads(json.dumps(body, default=str))

    peers = Coordinator(engines[0], ["http://n1", "http://n2"], fetch)
    ask = lambda path, **params: handle(engines[0], path, params, peers)[1]
    for text in FILTERS[:4]:
        found = [brute(rows, parse(text)) for rows in nodes]
        got = ask("/query", filter=text, agg="cardinality")
        assert (got["result"], got["matched"], got["partial"]) == (len({u for x in found for _, u in x}), sum(map(len, found)), False)
    assert ask("/query", agg="requestCount")["result"] == 150 and ask("/query", agg="totalLatency")["result"] == sum(r[4] for rows in nodes for r in rows)
    users = len({r[1] for rows in nodes for r in rows})
    assert abs(ask("/query", agg="distinctUsers")["result"] - users) < 0.1
    assert {x["value"]: x["count"] for x in ask("/facets")["country"]} == {v: len({(n, r[0], r[5], r[1]) for n, rows in enumerate(nodes) for r in rows if r[2] == v}) for v in ("PT", "NO", "KE")}
    series = ask("/timeseries", bucketSize="1h", filter="device:oven", agg="cardinality", to="1970-01-01T03:00:00Z", **{"from": "1970-01-01T00:00:00Z"})
    assert [r["result"] for r in series] == [len({u for rows in nodes for (_, h), u in brute(rows, parse("device:oven")) if h == hour}) for hour in range(3)]
    assert [(n["node"], n["records"]) for n in ask("/nodes")] == [("self", 50), ("http://n1", 50), ("http://n2", 50)]
    assert len(peers.segments()) == sum(e.segments().count() for e in engines)
    away.add(2)
    got = ask("/query", agg="count")
    assert got["partial"] and got["result"] == sum(len({(r[0], r[5], r[1]) for r in rows}) for rows in nodes[:2])
    assert [n["up"] for n in ask("/nodes")] == [True, True, False]


def test_api(spark):
    e = engine(spark, ROWS)
    assert handle(e, "/health", {}) == (200, {"status": "ok"})
    assert handle(e, "/query", {"filter": "country:FR", "agg": "cardinality"})[1]["result"] == one(e.query("country:FR", "cardinality"))
    assert handle(e, "/query", {"filter": "country:"})[0] == 400
    assert handle(e, "/query", {"agg": "none"})[0] == 400
    assert handle(e, "/query", {"from": "1970-01-01T01:00:00", "to": "1970-01-01T02:00:00Z"})[1]["segments"] == 1
    assert len(handle(e, "/query", {"models": "roaring,bsi", "agg": "cardinality"})[1]["models"]) == 2
    assert handle(e, "/facets", {"topN": "1"})[1]["country"][0]["value"] == "FR"
    assert len(handle(e, "/timeseries", {"bucketSize": "1h"})[1]) == 4
    assert handle(e, "/timeseries", {"bucketSize": "9h"})[0] == 400
    assert handle(e, "/cardinality", {"dim": "country", "value": "DE"})[1]["result"] == 14
    assert handle(e, "/cardinality", {"dim": "country"})[0] == 400
    assert handle(e, "/nodes", {})[1][0]["records"] == 40
    assert len(handle(e, "/segments", {})[1]) == e.segments().count()
    assert handle(e, "/other", {})[0] == 404
    assert instant("1970-01-01T00:00:01Z") == 1000 and instant("x") is None
    assert parts("0,x,1") == [0, 1] and parts("x") is None


def test_schemas(spark):
    avro = {"type": "record", "name": "r", "fields": [{"name": "user", "type": ["null", {"type": "record", "name": "u", "fields": [{"name": "id", "type": "long"}]}]}, {"name": "country", "type": "int"}, {"name": "device", "type": {"type": "string"}}, {"name": "ms", "type": "int"}]}
    faults = schemas.check_avro(CFG, json.dumps(avro))
    assert faults == ["field country: country is int, not string", "field ts: no path ts"]
    assert len(schemas.check_json_schema(CFG, json.dumps({"properties": {"user": {"properties": {"id": {}}}}}))) == 4
    assert schemas.check_spark(CFG, spark.sql("SELECT named_struct('id', 1) AS user, 'x' AS country, 'y' AS device, 1 AS ms").schema) == ["field ts: no path ts"]
    with_registry = IndexConfig.parse(CONFIG.replace("consumerGroup: g", "consumerGroup: g, schemaRegistry: {url: 'http://r', format: avro}"))
    assert schemas.probe(CFG)[0] == "skipped"
    assert schemas.probe(with_registry, lambda url: json.dumps({"schema": json.dumps(avro)}))[0] == "invalid"
    assert schemas.probe(with_registry, lambda url: 1 / 0)[0] == "skipped"


def test_connectors_say_what_is_missing(spark):
    with pytest.raises(decode.MissingConnector):
        decode.kafka(spark, CFG)
    avro = IndexConfig.parse(CONFIG.replace("consumerGroup: g", "consumerGroup: g, schemaRegistry: {url: 'http://r', format: avro}"))
    raw = spark.createDataFrame([(b"x",)], "value binary")
    assert decode.decoded(raw, CFG).schema["value"].dataType.simpleString() == "string"
    with pytest.raises(decode.MissingConnector):
        decode.decoded(raw, avro, avro_schema="{}")


def test_kafka_options_and_columns(spark):
    import datetime

    at = lambda start, streaming: decode.kafka_options(IndexConfig.parse(CONFIG.replace("consumerGroup: g", f"consumerGroup: g, startOffset: '{start}'")), streaming)
    assert at("latest", True) == {"kafka.bootstrap.servers": "b", "subscribe": "t", "kafka.group.id": "g", "failOnDataLoss": "false", "startingOffsets": "latest"}
    assert at("latest", False)["startingOffsets"] == at("earliest", True)["startingOffsets"] == "earliest"
    assert at("timestamp:1970-01-01T00:00:05", True)["startingTimestamp"] == at("timestamp:1970-01-01T01:00:05+01:00", True)["startingTimestamp"] == "5000"
    texts = [json.dumps({"user": {"id": 5}, "country": "PT", "device": "lamp", "ms": 1, "ts": 7}), "no json"]
    raw = spark.createDataFrame([(bytearray(t.encode()), 3, i, datetime.datetime(2024, 1, 1)) for i, t in enumerate(texts)], "value binary, partition int, offset long, timestamp timestamp")
    rows = decode.decoded(decode.from_kafka(raw), CFG)
    got = cells(rows, CFG, F.col("part"), F.col("offset"), F.col("source_ms"), json="value").collect()
    assert [(r.part, r.offset, r.ts_ms, r.member, r.dim_country) for r in got] == [(3, 0, 7, 5, "PT")]


def test_synthetic(spark):
    df = decode.synthetic(spark, rows=2000, users=100)
    row = df.agg(F.count("*").alias("n"), F.max("userId").alias("u"), F.count_distinct("country").alias("c"), F.min("latency").alias("l")).first()
    assert row.n == 2000 and row.u < 100 and row.c > 5 and row.l >= 0


def test_command_line(tmp_path, capsys):
    good, bad = tmp_path / "good.yaml", tmp_path / "bad.yaml"
    good.write_text(EVENTS)
    bad.write_text(EVENTS.replace("bucket: 1d", "bucket: x"))
    assert main(["--config", str(good)]) == 0
    assert "4 metrics" in capsys.readouterr().out
    assert main(["-c", str(bad)]) == 2


def test_windows_close_after_the_watermark(spark, tmp_path):
    import datetime

    from cohortlake.streaming.ingest import open_segments

    at = datetime.datetime(2024, 1, 1)
    # members that lie 32,768 apart have one place in two bitmaps
    rows = [(at + datetime.timedelta(minutes=m), u) for m, u in ((1, 1), (2, 32_769), (59, 65_537), (59, 40_000), (59, 1), (61, 7), (300, 8))]
    spark.createDataFrame(rows, "ts timestamp, member long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, member long").parquet(str(tmp_path / "in"))
    query = open_segments(stream, "1 hour", "10 minutes").writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.records, r.members) for r in spark.sql("SELECT sum(records) AS records, sum(bitmap_count(members)) AS members FROM closed GROUP BY window").collect())
    assert got == [(1, 1), (5, 4)]


def test_batches_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(catalogue, "scratch", lambda s: f"{tmp_path}/scratch")
    monkeypatch.setattr(Ingest, "batch", lambda self, records, batch_id=None: (self.store.append(self.index(records).dropDuplicates(["part", "offset"])), None)[1])
    catalogue._streamed(spark, str(tmp_path))
    assert len([p for p in (tmp_path / "scratch/checkpoint/commits").iterdir() if p.name.isdigit()]) == 2
