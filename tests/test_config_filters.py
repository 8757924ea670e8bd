import warnings

import pytest

from cohortlake.functions.durations import duration_ms
from cohortlake.plans.config import ConfigError, IndexConfig
from cohortlake.plans.filters import Always, And, Between, FilterError, Not, OneOf, Or, parse
from cohortlake.plans.fixtures import EVENTS


@pytest.mark.parametrize(("text", "ms"), [("500ms", 500), ("30s", 30_000), ("5m", 300_000), ("1h", 3_600_000), ("7d", 604_800_000)])
def test_durations(text, ms):
    assert duration_ms(text) == ms


@pytest.mark.parametrize("text", ["", "1", "h", "1w", "1.5h", "-1s", None])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_ms(text)


def test_config_loads():
    cfg = IndexConfig.parse(EVENTS, validate=True)
    assert cfg.bucket_ms == 86_400_000
    assert cfg.dimension("vb").bucket.base == 2.0
    assert cfg.metric("distinctK").sliceBy == ["event_type"]


def test_config_faults_come_together():
    text = EVENTS.replace("field: user, encoding: raw_uint32", "field: nobody, encoding: raw_uint32").replace("precision: 12", "precision: 30").replace("bucket: 1d", "bucket: 1w").replace("sliceBy: [event_type]", "sliceBy: [none]")
    with pytest.raises(ConfigError) as e:
        IndexConfig.parse(text, validate=True)
    assert len(e.value.errors) == 4
    IndexConfig.parse(text)


@pytest.mark.parametrize("change", [("kind: IndexerConfig", "kind: IndexerConfig\nextra: 1"), ("encoding: dict", "encoding: other"), ("storage: {path: events}", ""), ("maxOpenSegments: 2", "maxOpenSegments: two")])
def test_config_shape(change):
    with pytest.raises(ConfigError):
        IndexConfig.parse(EVENTS.replace(*change))


def test_unused_settings_warn():
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        IndexConfig.parse(EVENTS.replace("strategy: time", "strategy: hybrid"), validate=True)
    assert any("strategy" in str(w.message) for w in found)


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        (None, Always()),
        ("  ", Always()),
        ("a:1", OneOf("a", ("1",))),
        ("a:x, y", OneOf("a", ("x", "y"))),
        ('a:"x y,z"', OneOf("a", ("x y,z",))),
        ('a:">5"', OneOf("a", (">5",))),
        ("a:>5", Between("a", 6, None)),
        ("a:>= -5", Between("a", -5, None)),
        ("a:<5", Between("a", None, 4)),
        ("a:<=5", Between("a", None, 5)),
        ("a:[1,5]", Between("a", 1, 5)),
        ("a:1 and b:2 or c:3", Or(And(OneOf("a", ("1",)), OneOf("b", ("2",))), OneOf("c", ("3",)))),
        ("a:1 or not b:2 and c:3", Or(OneOf("a", ("1",)), And(Not(OneOf("b", ("2",))), OneOf("c", ("3",))))),
        ("not (a:1 OR b:2)", Not(Or(OneOf("a", ("1",)), OneOf("b", ("2",))))),
        ("notes:1", OneOf("notes", ("1",))),
        ("a:1 OR b:2 OR c:3", Or(Or(OneOf("a", ("1",)), OneOf("b", ("2",))), OneOf("c", ("3",)))),
    ],
)
def test_filters(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize("text", ["a", "a:", "a:1 AND", "(a:1", 'a:"x', "a:1 b:2", "a:>x", "a:[1,x]", "a:[1,2", ":1", "not:1", "a:1)", "a:>99999999999999999999"])
def test_bad_filters(text):
    with pytest.raises(FilterError):
        parse(text)
