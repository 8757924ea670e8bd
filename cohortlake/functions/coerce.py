"""Typed field values as Columns: dotted paths, coercion, event time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TEXT = "^[+-]?[0-9]{1,19}$"
NUMBER_TEXT = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"


def at_path(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The column at a dotted path through structs and string-keyed maps, and its type; None if there is none."""
    kind: T.DataType = schema
    out: Column | None = None
    for part in filter(None, path.split(".")):
        if isinstance(kind, T.StructType) and part in kind.names:
            kind = kind[part].dataType
            out = F.col(f"`{part}`") if out is None else out.getField(part)
        elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            kind, out = kind.valueType, out[part]
        else:
            return None
    return None if out is None else (out, kind)


def _long_of_number(x: Column) -> Column:
    return F.when(F.abs(x) < 9.3e18, F.floor(F.abs(x)) * F.signum(x)).try_cast("bigint")


def coerce(value: Column, kind: T.DataType, to: str) -> Column:
    """value of a Spark type as a declared type: numbers lose their fraction as integers, texts must be numbers throughout, else null."""
    text, number, truth = isinstance(kind, (T.StringType, T.CharType, T.VarcharType)), isinstance(kind, (*INTEGRAL, *FRACTIONAL)), isinstance(kind, T.BooleanType)
    null = F.lit(None)
    if to == "string":
        return value.cast("string") if text or number or truth or isinstance(kind, T.BinaryType) else F.to_json(value) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else value.cast("string")
    if to == "bytes":
        return value.cast("binary") if text or isinstance(kind, T.BinaryType) else null.cast("binary")
    if to == "bool":
        if truth:
            return value
        return value != 0 if number else F.lower(value) == "true" if text else null.cast("boolean")
    if to in ("float", "double"):
        if number:
            return value.cast("double")
        return F.when(value.rlike(NUMBER_TEXT), value.try_cast("double")) if text else null.cast("double")
    if isinstance(kind, INTEGRAL):
        return value.cast("bigint")
    if number:
        return _long_of_number(value.cast("double"))
    if truth:
        return value.cast("int").cast("bigint")
    return F.when(value.rlike(INTEGER_TEXT), value.try_cast("bigint")) if text else null.cast("bigint")


def coerce_json(json: Column, path: str, to: str) -> Column:
    """The value at a path of a JSON text as a declared type. json is a VARIANT, so texts and numbers are told apart."""
    where = "$" + "".join(f"['{p}']" for p in filter(None, path.split(".")))
    value = F.try_variant_get(json, where, "variant")
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(json, where, "string")
    quoted = kind == "STRING"
    if to == "string":
        return text
    if to == "bytes":
        return F.when(quoted, text.cast("binary"))
    if to == "bool":
        number = F.try_variant_get(json, where, "double")
        return F.when(quoted, F.lower(text) == "true").when(kind == "BOOLEAN", F.try_variant_get(json, where, "boolean")).otherwise(number != 0)
    if to in ("float", "double"):
        return F.when(quoted, coerce(text, T.StringType(), to)).when(kind != "BOOLEAN", F.try_variant_get(json, where, "double"))
    whole = F.when(kind == "BIGINT", F.try_variant_get(json, where, "bigint")).when(kind == "BOOLEAN", F.try_variant_get(json, where, "boolean").cast("int").cast("bigint"))
    return F.when(quoted, coerce(text, T.StringType(), to)).otherwise(F.coalesce(whole, _long_of_number(F.try_variant_get(json, where, "double"))))


def epoch_ms(value: Column, kind: T.DataType) -> Column:
    """Milliseconds of a timestamp, date or text with an instant."""
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        value = value.cast("timestamp")
    elif isinstance(kind, T.StringType):
        value = value.try_cast("timestamp")
    return F.unix_millis(value)


def event_ms(value: Column, kind: T.DataType, unit: str | None, fallback: Column) -> Column:
    """Event time in milliseconds: numbers by unit, texts and timestamps as instants, else the fallback."""
    if isinstance(kind, INTEGRAL):
        scale = {"s": value * 1000, "us": F.floor(value / 1000), "ns": F.floor(value / 1_000_000)}
        own = {"us": value - value % 1000, "ns": value - value % 1_000_000}
        exact = {"s": scale["s"], "us": (own["us"] / 1000), "ns": (own["ns"] / 1_000_000)}
        ms = exact.get(unit or "ms", value).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)):
        ms = epoch_ms(value, kind)
    elif isinstance(kind, FRACTIONAL):
        return event_ms(_long_of_number(value.cast("double")), T.LongType(), unit, fallback)
    else:
        ms = F.lit(None).cast("bigint")
    return F.coalesce(ms, fallback)
