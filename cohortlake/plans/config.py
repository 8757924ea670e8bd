"""The declarative index document: YAML into dataclasses, with all faults reported at once."""

from __future__ import annotations

import re
import types
import typing
import warnings
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, Literal

import yaml

from cohortlake.functions.durations import duration_ms

# The names, choices and defaults of the document format.
INTEGERS = ("uint8", "uint16", "uint32", "uint64", "int32", "int64")
FieldType = Literal["string", "bytes", "uint8", "uint16", "uint32", "uint64", "int32", "int64", "float", "double", "bool"]
Overflow = Literal["reject", "overflow", "halt"]


class ConfigError(ValueError):
    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Metadata:
    name: str
    description: str | None = None


@dataclass(frozen=True)
class Registry:
    url: str
    format: Literal["avro", "protobuf", "json-schema", "json"]


@dataclass(frozen=True)
class Source:
    topic: str
    bootstrap: str
    consumerGroup: str
    startOffset: str = "latest"
    schemaRegistry: Registry | None = None
    parallelism: int = 1


@dataclass(frozen=True)
class Segmentation:
    bucket: str
    strategy: Literal["time", "record_count", "hybrid"] = "time"
    alignment: Literal["utc", "none"] = "utc"
    retention: str | None = None
    maxOpenSegments: int = 2


@dataclass(frozen=True)
class Field:
    path: str
    type: FieldType
    unit: Literal["ms", "us", "ns", "s"] | None = None


@dataclass(frozen=True)
class MemberDict:
    persist: bool = True
    snapshotEvery: str | None = None
    maxSize: int | None = None
    onOverflow: Overflow = "reject"


@dataclass(frozen=True)
class Member:
    field: str
    encoding: Literal["raw_uint32", "dict", "hash64"]
    dict: MemberDict | None = None


@dataclass(frozen=True)
class Bucket:
    type: Literal["linear", "exponential", "explicit"]
    step: float | None = None
    base: float | None = None
    min: float | None = None
    max: float | None = None
    boundaries: list[float] | None = None


@dataclass(frozen=True)
class Dimension:
    name: str
    field: str
    encoding: Literal["dict", "raw_uint32", "hash32", "hash64"]
    hashAlgo: Literal["murmur3", "xxh3"] | None = None
    maxCardinality: int | None = None
    onOverflow: Overflow = "reject"
    bucket: Bucket | None = None

    @property
    def numeric(self) -> bool:
        return self.encoding == "raw_uint32"

    @property
    def hashed(self) -> bool:
        return self.encoding in ("hash32", "hash64")


@dataclass(frozen=True)
class Metric:
    name: str
    type: Literal["ull", "hll", "cpc", "count", "sum"]
    field: str | None = None
    precision: int | None = None
    hashSeed: int | None = None
    sliceBy: list[str] | None = None


@dataclass(frozen=True)
class Storage:
    path: str
    format: str = "portable"
    compress: Literal["none", "zstd"] = "zstd"
    mmap: bool = True
    flushOnRoll: bool = True


@dataclass(frozen=True)
class Http:
    bind: str = "0.0.0.0:8080"
    auth: Literal["none", "bearer", "mtls"] = "none"


@dataclass(frozen=True)
class Query:
    http: Http = field(default_factory=Http)
    maxSegmentsPerQuery: int = 720
    cachePlans: bool = True
    parallelism: int | None = None
    parallelThreshold: int = 8
    peers: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Models:
    bsiDims: list[str] = field(default_factory=list)
    thetaSample: bool = False
    thetaSampleRate: float = 0.0625
    jointProfile: bool = False
    reorderMembers: bool = True


@dataclass(frozen=True)
class IndexConfig:
    metadata: Metadata
    source: Source
    segmentation: Segmentation
    fields: dict[str, Field]
    member: Member
    dimensions: list[Dimension]
    storage: Storage
    apiVersion: str = "v1"
    kind: str = "IndexerConfig"
    timeField: str | None = None
    metrics: list[Metric] = field(default_factory=list)
    query: Query = field(default_factory=Query)
    observability: dict[str, Any] = field(default_factory=dict)
    experimentalModels: Models = field(default_factory=Models)

    @property
    def bucket_ms(self) -> int:
        return duration_ms(self.segmentation.bucket)

    @property
    def retention_ms(self) -> int | None:
        return duration_ms(self.segmentation.retention) if self.segmentation.retention else None

    def dimension(self, name: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == name), None)

    def metric(self, name: str) -> Metric | None:
        return next((m for m in self.metrics if m.name == name), None)

    @staticmethod
    def parse(text: str, validate: bool = False) -> IndexConfig:
        """The document as given; validate adds the checks between its parts."""
        errors: list[str] = []
        cfg = _read(IndexConfig, yaml.safe_load(text), "", errors)
        if errors:
            raise ConfigError(errors)
        if validate:
            faults = check(cfg)
            if faults:
                raise ConfigError(faults)
            for name in unused(cfg):
                warnings.warn(f"{name} has no effect", stacklevel=2)
        return cfg

    @staticmethod
    def load(path: str | Path) -> IndexConfig:
        return IndexConfig.parse(Path(path).read_text(), validate=True)


def _read(kind: Any, value: Any, at: str, errors: list[str]) -> Any:
    """value as the annotated kind; what does not fit is noted in errors."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        return None if value is None else _read(next(a for a in args if a is not type(None)), value, at, errors)
    if kind is Any:
        return value
    if origin is Literal:
        if value not in args:
            errors.append(f"{at}: {value!r} is not one of {', '.join(map(str, args))}")
        return value
    if origin is list:
        if not isinstance(value, list):
            errors.append(f"{at}: a list is expected")
            return []
        return [_read(args[0], v, f"{at}[{i}]", errors) for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            errors.append(f"{at}: a mapping is expected")
            return {}
        return {k: _read(args[1], v, f"{at}.{k}".strip("."), errors) for k, v in value.items()}
    if is_dataclass(kind):
        if not isinstance(value, dict):
            errors.append(f"{at or 'document'}: a mapping is expected")
            return None
        hints, out = typing.get_type_hints(kind), {}
        known = {f.name: f for f in fields(kind)}
        errors += [f"{at}.{k}".strip(".") + ": unknown" for k in value if k not in known]
        for name, f in known.items():
            place = f"{at}.{name}".strip(".")
            if name in value and not (value[name] is None and f.default is not MISSING):
                out[name] = _read(hints[name], value[name], place, errors)
            elif f.default is MISSING and f.default_factory is MISSING:
                errors.append(f"{place}: missing")
                out[name] = None
        return kind(**out)
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool):
        errors.append(f"{at}: {kind.__name__} is expected, not {value!r}")
    return value


def check(cfg: IndexConfig) -> list[str]:
    """Faults between the parts of a document that is well formed."""
    out: list[str] = []
    if not re.fullmatch(r"[a-z0-9][a-z0-9-]{2,62}", cfg.metadata.name):
        out.append(f"metadata.name: {cfg.metadata.name!r} is not a name")
    for what, name in (("member.field", cfg.member.field), ("timeField", cfg.timeField)):
        if name is not None and name not in cfg.fields:
            out.append(f"{what}: no field {name!r}")
    if not cfg.dimensions:
        out.append("dimensions: none")
    for group in (cfg.dimensions, cfg.metrics):
        names = [x.name for x in group]
        out += [f"{n}: named twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for d in cfg.dimensions:
        f = cfg.fields.get(d.field)
        if f is None:
            out.append(f"dimension {d.name}: no field {d.field!r}")
        elif d.encoding == "dict" and f.type not in ("string", "bytes", *INTEGERS):
            out.append(f"dimension {d.name}: dict needs a string, bytes or integer field, not {f.type}")
        elif d.encoding == "raw_uint32" and f.type not in INTEGERS and not (d.bucket and f.type in ("float", "double")):
            out.append(f"dimension {d.name}: raw_uint32 needs an integer field, not {f.type}")
        if d.bucket:
            needs = {"linear": "step", "exponential": "base", "explicit": "boundaries"}[d.bucket.type]
            if getattr(d.bucket, needs) in (None, []):
                out.append(f"dimension {d.name}: a {d.bucket.type} bucket needs {needs}")
    for m in cfg.metrics:
        f = cfg.fields.get(m.field) if m.field else None
        if m.field and f is None:
            out.append(f"metric {m.name}: no field {m.field!r}")
        if m.type in ("ull", "hll", "cpc"):
            if m.field is None:
                out.append(f"metric {m.name}: {m.type} needs a field")
            if m.precision is None or not 4 <= m.precision <= 20:
                out.append(f"metric {m.name}: {m.type} needs a precision from 4 to 20")
        if m.type == "sum":
            if m.field is None:
                out.append(f"metric {m.name}: sum needs a field")
            elif f and f.type not in (*INTEGERS, "float", "double"):
                out.append(f"metric {m.name}: sum needs a numeric field, not {f.type}")
        out += [f"metric {m.name}: no dimension {s!r} to slice by" for s in m.sliceBy or [] if cfg.dimension(s) is None]
    out += [f"experimentalModels.bsiDims: no dimension {n!r}" for n in cfg.experimentalModels.bsiDims if cfg.dimension(n) is None]
    if not 0 < cfg.experimentalModels.thetaSampleRate <= 1:
        out.append("experimentalModels.thetaSampleRate: outside (0, 1]")
    for what, text in (("bucket", cfg.segmentation.bucket), ("retention", cfg.segmentation.retention)):
        try:
            if text is not None and duration_ms(text) == 0:
                out.append(f"segmentation.{what}: zero")
        except ValueError as e:
            out.append(f"segmentation.{what}: {e}")
    return out


def unused(cfg: IndexConfig) -> list[str]:
    """Settings that are accepted but that Spark has no use for."""
    out = []
    if cfg.segmentation.strategy != "time":
        out.append("segmentation.strategy")
    if cfg.source.parallelism != 1:
        out.append("source.parallelism")
    if cfg.query.http.auth != "none":
        out.append("query.http.auth")
    out += [f"dimension {d.name}: hashAlgo" for d in cfg.dimensions if d.hashAlgo and not d.hashed]
    if cfg.member.dict and (cfg.member.encoding != "dict" or cfg.member.dict.snapshotEvery):
        out.append("member.dict")
    return out + [f"metric {m.name}: hashSeed" for m in cfg.metrics if m.hashSeed is not None]
