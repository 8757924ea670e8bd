import json
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.functions import encoders
from cohortlake.functions.coerce import coerce, coerce_json
from cohortlake.operators import models
from cohortlake.operators.cells import TooManySegments, cells
from cohortlake.operators.federate import Federation
from cohortlake.operators.queries import Engine, UnsupportedQuery
from cohortlake.plans.config import Bucket, IndexConfig
from cohortlake.plans.filters import And, Not, OneOf, Or, parse

CONFIG = """
apiVersion: v1
kind: IndexerConfig
metadata: {name: small}
source: {topic: t, bootstrap: b, consumerGroup: g}
segmentation: {bucket: 1h, strategy: time}
fields:
  userId: {path: user.id, type: uint32}
  country: {path: country, type: string}
  device: {path: device, type: string}
  latency: {path: ms, type: uint32}
  ts: {path: ts, type: uint64}
timeField: ts
member: {field: userId, encoding: raw_uint32}
dimensions:
  - {name: country, field: country, encoding: dict}
  - {name: device, field: device, encoding: dict}
  - {name: latencyMs, field: latency, encoding: raw_uint32}
metrics:
  - {name: requestCount, type: count}
  - {name: totalLatency, type: sum, field: latency}
  - {name: distinctUsers, type: ull, field: userId, precision: 12}
  - {name: distinctCountries, type: ull, field: country, precision: 12}
storage: {path: small}
experimentalModels: {bsiDims: [latencyMs], thetaSample: true, thetaSampleRate: 0.5, jointProfile: true}
"""
CFG = IndexConfig.parse(CONFIG, validate=True)


def engine(spark, rows, cfg=CFG):
    """rows: (part, user, country, device, latency, ts)."""
    data = [(p, i, json.dumps({"user": {"id": u}, "country": c, "device": d, "ms": m, "ts": t})) for i, (p, u, c, d, m, t) in enumerate(rows)]
    raw = spark.createDataFrame(data, "part int, offset long, value string")
    return Engine(cells(raw, cfg, F.col("part"), F.col("offset"), json="value"), cfg)


def one(df, name="result"):
    return df.first()[name]


def simple(spark, *rows):
    return engine(spark, [(p, u, c, d, 10, 0) for p, u, c, d in rows])


def random_rows(seed, n=150, parts=3):
    rnd = random.Random(seed)
    return [(rnd.randrange(parts), rnd.randrange(30), rnd.choice(["PT", "NO", "KE", None]), rnd.choice(["lamp", "fridge", "oven"]), rnd.randrange(90), rnd.randrange(3) * 3_600_000) for _ in range(n)]


FILTERS = ("country:PT", "country:PT,NO AND device:oven", "NOT country:KE", "device:lamp AND NOT (country:NO OR device:fridge)", "country:KE OR NOT device:lamp", "country:none")


def test_filters_are_algebra_of_members(spark):
    rows = random_rows(1)
    e = engine(spark, rows)
    for text in FILTERS:
        want = brute(rows, parse(text))
        got = e.query(text, "cardinality").first()
        assert (got.result, got.matched, got.segments) == (len({u for _, u in want}), len(want), 9), text
        assert one(e.query(text, "count")) == len(want)
        only = brute([r for r in rows if r[0] in (0, 2)], parse(text))
        assert one(e.query(text, "count", parts=[0, 2])) == len(only)
    assert one(e.query("country:PT", "requestCount")) == len(rows)
    assert one(e.query(None, "totalLatency")) == sum(r[4] for r in rows)


def test_leaves_reach_the_scan(spark, tmp_path):
    engine(spark, random_rows(2)).cells.write.parquet(f"{tmp_path}/cells")
    e = Engine(spark.read.parquet(f"{tmp_path}/cells"), CFG)
    plan = lambda text: e.hits(parse(text), canonical=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(EqualTo(dim_country,PT),EqualTo(dim_device,oven))]" in plan("country:PT AND device:oven")
    assert "Or(" not in plan("country:PT OR NOT device:oven").split("PushedFilters")[1][:80]


def test_and_is_of_members_not_rows(spark):
    e = simple(spark, (0, 1, "FR", "mobile"), (0, 1, "DE", "desktop"), (1, 2, "FR", "mobile"))
    assert one(e.query("country:FR AND country:DE", "cardinality")) == 1
    assert one(e.query("country:FR AND device:desktop", "cardinality")) == 1


def test_unknown_and_unsupported(spark):
    e = simple(spark, (0, 1, "FR", "mobile"))
    assert one(e.query("nothing:1", "cardinality")) == 0
    assert one(e.query("NOT nothing:1", "cardinality")) == 1
    with pytest.warns(UserWarning):
        assert one(e.query("country:>1", "cardinality")) == 0
    with pytest.raises(UnsupportedQuery):
        e.query(None, "none")
    with pytest.raises(UnsupportedQuery):
        e.query("country:FR", "distinctCountries")
    assert one(e.query("country:FR", "distinctUsers")) == 1
    assert abs(one(e.query(None, "distinctCountries")) - 1) < 0.01
    with pytest.raises(UnsupportedQuery):
        e.timeseries("2h")
    with pytest.raises(UnsupportedQuery):
        e.legacy_cardinality("country", "")


def test_nulls(spark):
    e = engine(spark, [(0, None, "FR", "mobile", 1, 0), (0, 1, None, None, None, 0), (0, 2, None, "mobile", 5, 0)])
    assert one(e.query(None, "cardinality")) == 1  # user 1 has no dimension, the first record no member
    assert one(e.query(None, "requestCount")) == 2
    assert one(e.query("NOT country:FR", "cardinality")) == 1
    empty = Engine(e.cells.where("false"), CFG)
    assert one(empty.query(None, "cardinality")) == 0
    assert one(empty.query(None, "totalLatency")) == 0
    assert empty.timeseries("1h").count() == 0
    assert empty.facets().count() == 0


def test_time_is_of_whole_segments(spark):
    hour = 3_600_000
    e = engine(spark, [(0, u, "FR", "mobile", 1, u * hour + 60_000) for u in range(5)])
    assert one(e.query(None, "cardinality", start=hour + 120_000, end=2 * hour + 1)) == 2
    steps = [r.result for r in e.timeseries("1h", None, "cardinality").orderBy("step_start").collect()]
    assert steps == [1, 1, 1, 1, 1]
    wide = e.timeseries("6h", None, "count", start=-hour, end=9 * hour).orderBy("step_start").collect()
    assert [(r.step_end - r.step_start, r.result) for r in wide] == [(6 * hour, 5), (4 * hour, 0)]
    totals = [r.result for r in e.timeseries("6h", None, "totalLatency").collect()]
    assert totals == [5]


def test_facets_with_ties(spark):
    e = simple(spark, (0, 1, "FR", "mobile"), (0, 2, "FR", "mobile"), (0, 3, "DE", "mobile"), (1, 4, "FR", "mobile"), (1, 5, "US", "mobile"))
    got = {(r.value, r["count"]) for r in e.facets().where("dim = 'country'").collect()}
    assert got == {("FR", 3), ("DE", 1), ("US", 1)}
    assert {r.value for r in e.facets(top=2).where("dim = 'country'").collect()} == {"FR", "DE"}


def test_guard_and_catalog(spark):
    e = engine(spark, [(0, 1, "FR", "mobile", 1, h * 3_600_000) for h in range(3)])
    assert e.guard() == 3
    small = IndexConfig.parse(CONFIG.replace("storage:", "query: {maxSegmentsPerQuery: 2}\nstorage:"))
    with pytest.raises(TooManySegments):
        Engine(e.cells, small).guard()
    row = e.segments().orderBy("start_ms").first()
    assert (row.records, row.values_country, row.end_ms) == (1, 1, 3_600_000)


@pytest.mark.parametrize(("mode", "values"), [("reject", {"A", "B", None}), ("overflow", {"A", "B", "__overflow__"})])
def test_cardinality_guard(spark, mode, values):
    cfg = IndexConfig.parse(CONFIG.replace("name: country, field: country, encoding: dict", f"name: country, field: country, encoding: dict, maxCardinality: 2, onOverflow: {mode}"))
    e = engine(spark, [(0, i, c, "m", 1, 0) for i, c in enumerate("ABCAD")], cfg)
    assert {r.dim_country for r in e.cells.collect()} == values
    assert one(e.query(None, "requestCount")) == 5


def test_cardinality_halt(spark):
    cfg = IndexConfig.parse(CONFIG.replace("name: country, field: country, encoding: dict", "name: country, field: country, encoding: dict, maxCardinality: 2, onOverflow: halt"))
    with pytest.raises(Exception, match="more than 2 values"):
        engine(spark, [(0, i, c, "m", 1, 0) for i, c in enumerate("ABC")], cfg).cells.collect()


def brute(rows, tree):
    """(segment, user) of the users that a filter finds, segment by segment."""
    cells = {}
    for p, u, c, d, m, t in rows:
        cells.setdefault((p, t // 3_600_000), []).append((u, c, d, m))

    def members(rows, tree):
        if isinstance(tree, OneOf):
            at = {"country": 1, "device": 2}[tree.dim]
            return {r[0] for r in rows if r[at] in tree.values}
        if isinstance(tree, Not):
            return {r[0] for r in rows} - members(rows, tree.inner)
        both = members(rows, tree.left), members(rows, tree.right)
        return both[0] & both[1] if isinstance(tree, And) else both[0] | both[1]

    return {(k, u) for k, rows in cells.items() for u in members(rows, tree)}


def test_models_agree_with_sets(spark):
    rnd = random.Random(5)
    rows = [(rnd.randrange(2), rnd.randrange(40), rnd.choice("FR DE IT ES".split()), rnd.choice("mobile desktop tablet".split()), rnd.randrange(500), rnd.randrange(2) * 3_600_000) for _ in range(200)]
    e = engine(spark, rows)
    for text in ("country:FR AND NOT device:mobile", "(country:DE,IT OR device:tablet) AND NOT country:ES", "NOT (country:FR OR country:DE)"):
        tree = parse(text)
        assert isinstance(tree, (And, Not, Or))
        want = float(len({u for _, u in brute(rows, tree)}))
        got = {r.model: r.value for r in models.compare(e, "roaring,bsi,joint_profile,reordered", text).collect()}
        assert got == dict.fromkeys(("roaring", "bsi", "joint_profile", "reordered"), want)


def test_last_value_wins(spark):
    e = engine(spark, [(0, 1, "FR", "m", 10, 0), (0, 1, "FR", "m", 300, 0), (0, 2, "FR", "m", 20, 0)])
    assert one(e.query("latencyMs:[5,50]", "cardinality")) == 1
    assert one(e.query("latencyMs:[5,50]", "cardinality", canonical=True)) == 2
    assert one(models.last_value_sum(e, "latencyMs")) == 320
    assert models.permutation(e.cells, CFG).count() == 2


def test_model_support(spark):
    e = simple(spark, (0, 1, "FR", "mobile"))
    got = {r.model: (r.supported, r.error) for r in models.compare(e, "theta,joint_profile,bsi", "latencyMs:>1").collect()}
    assert got["theta"][0] is False and got["joint_profile"][0] is False and got["bsi"] == (True, None)
    assert models.model_list("BSI, nope,theta,bsi") == ["bsi", "theta"]
    assert models.model_list("nope") == ["roaring"]


def test_theta_is_near(spark):
    e = engine(spark, [(0, u, "FR" if u % 2 else "DE", "m", 1, 0) for u in range(2000)])
    got = models.theta_estimate(e, "country:FR").first()
    assert abs(got.result - 1000) < 150


def test_federation(spark):
    """Nodes that have the same parts and times: each evaluates for itself."""
    nodes = {f"n{i}": random_rows(10 + i, 60) for i in range(3)}
    f = Federation({n: engine(spark, rows).cells for n, rows in nodes.items()}, CFG)
    for text in FILTERS:
        found = [brute(rows, parse(text)) for rows in nodes.values()]
        got = f.query(text, "cardinality").first()
        assert (got.result, got.matched, got.partial) == (len({u for x in found for _, u in x}), sum(map(len, found)), False), text
        assert one(f.query(text, "count")) == sum(map(len, found))
        assert one(f.query(text, "distinctUsers")) == got.result
    segments = sum(len({(r[0], r[5]) for r in rows}) for rows in nodes.values())
    assert f.query(None, "requestCount").first().asDict() == {"segments": segments, "matched": 180, "result": 180, "metric": "requestCount", "approx": False, "partial": False}
    assert f.segments().count() == segments and {(r.node, r.up, r.records) for r in f.nodes().collect()} == {(n, True, 60) for n in nodes}
    users = len({r[1] for rows in nodes.values() for r in rows})
    assert one(f.query(None, "distinctUsers")) == pytest.approx(users, abs=0.1)
    series = f.timeseries("1h", "device:oven", "cardinality", start=0, end=3 * 3_600_000).orderBy("step_start").collect()
    want = [len({u for rows in nodes.values() for (_, h), u in brute(rows, parse("device:oven")) if h == hour}) for hour in range(3)]
    assert [r.result for r in series] == want and not any(r.partial for r in series)
    counts = {v: len({(n, r[0], r[5], r[1]) for n, rows in nodes.items() for r in rows if r[2] == v}) for v in ("PT", "NO", "KE")}
    assert {(r.value, r["count"]) for r in f.facets().where("dim = 'country'").collect()} == set(counts.items())
    some = Federation({n: engine(spark, rows).cells for n, rows in nodes.items()}, CFG, ["n0"])
    assert some.query(None, "count").first().partial and {(r.node, r.up) for r in some.nodes().collect()} == {("n0", True), ("n1", False), ("n2", False)}


def test_facets_are_not_cut_before_they_are_added(spark):
    rows = [(0, u, f"c{v:04}", "x", 1, 0) for v in range(1005) for u in range(2 if v < 1003 else 1)]
    low = {"a": [r for r in rows if not (r[2] == "c1004")] + [(0, 9, "c1004", "x", 1, 0)], "b": [(0, u, "c1004", "x", 1, 0) for u in range(3)]}
    f = Federation({n: engine(spark, r).cells for n, r in low.items()}, CFG)
    assert f.facets(top=1).where("dim = 'country'").first().asDict() == {"dim": "country", "value": "c1004", "count": 4, "partial": False}


@pytest.mark.parametrize("encoding", ["hash32", "hash64, hashAlgo: murmur3", "hash64"])
def test_hashed_dimensions_and_members(spark, encoding):
    text = CONFIG.replace("{name: country, field: country, encoding: dict}", f"{{name: country, field: country, encoding: {encoding}}}").replace("member: {field: userId, encoding: raw_uint32}", "member: {field: device, encoding: hash64}")
    rows = random_rows(4)
    e = engine(spark, rows, IndexConfig.parse(text, validate=True))
    assert dict(e.cells.dtypes)["dim_country"] == "bigint" and dict(e.cells.dtypes)["member"] == "bigint"
    assert all(0 <= r.dim_country < 1 << 32 for r in e.cells.select("dim_country").dropna().collect())
    assert one(e.query("country:PT,KE", "count")) == len({(r[0], r[5], r[3]) for r in rows if r[2] in ("PT", "KE")})
    assert one(e.query(None, "cardinality")) == 3


def test_members_beyond_the_dictionary(spark):
    text = CONFIG.replace("member: {field: userId, encoding: raw_uint32}", "member: {field: device, encoding: dict, dict: {maxSize: 2, onOverflow: %s}}")
    rows = [(0, 1, "PT", d, 1, 0) for d in ("a", "b", "a", "c", "d")]
    members = lambda mode: sorted(r.member for r in engine(spark, rows, IndexConfig.parse(text % mode)).cells.collect())
    assert members("reject") == ["a", "a", "b"] and members("overflow") == ["__overflow__"] * 2 + ["a", "a", "b"]
    with pytest.raises(Exception, match="member has more than 2"):
        members("halt")


def test_json_coercion(spark):
    texts = ['{"a":{"b":12.9}}', '{"a":{"b":"12"}}', '{"a":{"b":" 12"}}', '{"a":{"b":true}}', '{"a":{"b":"x"}}', '{"a":1}', "no json", '{"a":{"b":-7.9}}']
    df = spark.createDataFrame([(t,) for t in texts], "v string").select(F.try_parse_json("v").alias("j"))
    cast = {k: [r.x for r in df.select(coerce_json(F.col("j"), "a.b", k).alias("x")).collect()] for k in ("int64", "double", "string", "bool")}
    assert cast["int64"] == [12, 12, None, 1, None, None, None, -7]
    assert cast["double"] == [12.9, 12.0, None, None, None, None, None, -7.9]
    assert cast["string"][:5] == ["12.9", "12", " 12", "true", "x"]
    assert cast["bool"][3] is True


def test_json_is_parsed_once_a_record(spark):
    plan = engine(spark, [(0, 1, "FR", "mobile", 9, 0), (0, 2, None, None, None, None)]).cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (None, -5.0, 0.5, 1.0, 2.0, 3.0, 25.0, 1e9)], "v double")
    got = lambda c: [r.x for r in df.select(c.alias("x")).collect()]
    assert got(encoders.bucketed(F.col("v"), Bucket("linear", step=10.0, min=0.0, max=100.0)))[1:] == [0, 0, 0, 0, 0, 2, 10]
    assert got(encoders.bucketed(F.col("v"), Bucket("exponential", base=2.0, min=1.0, max=8.0))) == [None, 0, 0, 0, 2, 2, 4, 4]
    assert got(encoders.bucketed(F.col("v"), Bucket("explicit", boundaries=[1.0, 3.0]))) == [None, 0, 0, 1, 1, 2, 2, 2]
    assert got(coerce(F.col("v"), df.schema["v"].dataType, "uint8"))[1:3] == [-5, 0]


def test_bitmaps_and_legacy(spark):
    e = simple(spark, (0, 0, "FR", "m"), (0, 1, "FR", "m"), (1, 1, "FR", "m"), (1, 40000, "DE", "m"))
    assert one(e.bitmap_cardinality()) == 3
    assert one(e.legacy_cardinality("country", "FR")) == 3
    assert one(e.records("country:FR"), "records") == 3
