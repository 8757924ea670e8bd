"""Whether declared fields agree with a schema: Spark's, Avro's or JSON Schema's."""

from __future__ import annotations

import json
import urllib.request
from typing import Any

from pyspark.sql import types as T

from cohortlake.functions.coerce import at_path
from cohortlake.plans.config import INTEGERS, IndexConfig

# The Avro types that a declared type may be read from.
AVRO = {"string": {"string", "enum"}, "bytes": {"bytes"}, "bool": {"boolean"}, "float": {"float"}, "double": {"double", "float"}} | {k: {"int", "long"} for k in INTEGERS}


def check_spark(cfg: IndexConfig, schema: T.StructType) -> list[str]:
    """Faults of fields whose path is not in a DataFrame's schema, or leads to no single value."""
    out = []
    for name, f in cfg.fields.items():
        found = at_path(schema, f.path)
        if found is None:
            out.append(f"field {name}: no path {f.path}")
        elif isinstance(found[1], (T.StructType, T.ArrayType, T.MapType)) and f.type != "string":
            out.append(f"field {name}: {f.path} is {found[1].simpleString()}, not {f.type}")
    return out


def _plain(schema: Any) -> Any:
    if isinstance(schema, list):
        return next((_plain(s) for s in schema if s != "null"), None)
    if isinstance(schema, dict) and isinstance(schema.get("type"), (dict, list)):
        return _plain(schema["type"])
    return schema


def check_avro(cfg: IndexConfig, text: str) -> list[str]:
    root, out = json.loads(text), []
    for name, f in cfg.fields.items():
        at: Any = _plain(root)
        for part in filter(None, f.path.split(".")):
            named = {x["name"]: x["type"] for x in at.get("fields", [])} if isinstance(at, dict) else {}
            at = _plain(named[part]) if part in named else None
        kind = at.get("type") if isinstance(at, dict) else at
        if kind is None:
            out.append(f"field {name}: no path {f.path}")
        elif kind not in AVRO[f.type]:
            out.append(f"field {name}: {f.path} is {kind}, not {f.type}")
    return out


def check_json_schema(cfg: IndexConfig, text: str) -> list[str]:
    out = []
    for name, f in cfg.fields.items():
        at: Any = json.loads(text)
        for part in filter(None, f.path.split(".")):
            at = (at or {}).get("properties", {}).get(part)
        if at is None:
            out.append(f"field {name}: no path {f.path}")
    return out


def probe(cfg: IndexConfig, fetch=None, seconds: float = 2.0) -> tuple[str, list[str]]:
    """(ok, invalid or skipped, faults) of the topic's schema in the configured registry."""
    registry = cfg.source.schemaRegistry
    if registry is None:
        return "skipped", ["no registry"]
    url = f"{registry.url.rstrip('/')}/subjects/{cfg.source.topic}-value/versions/latest"
    try:
        text = fetch(url) if fetch else urllib.request.urlopen(url, timeout=seconds).read().decode()  # noqa: S310
        schema = json.loads(text)["schema"]
    except Exception as e:
        return "skipped", [str(e)]
    if registry.format == "avro":
        faults = check_avro(cfg, schema)
    elif registry.format == "json-schema":
        faults = check_json_schema(cfg, schema)
    else:
        return "skipped", [f"{registry.format} is not checked"]
    return ("invalid", faults) if faults else ("ok", [])
