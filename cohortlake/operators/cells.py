"""Records to cells: one row for each record with its segment (part, bucket), member and dimensions.

Columns: part, bucket (start in ms), offset, ts_ms, member, member_key, dim_<dimension>,
raw_<dimension> (for dimensions kept by last value), field_<field> (for metrics).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortlake.functions.coerce import at_path, coerce, coerce_json, event_ms
from cohortlake.functions.encoders import UINT32, bucketed, hashed, uint32
from cohortlake.plans.config import INTEGERS, Dimension, IndexConfig

OTHER = "__overflow__"
SEGMENT = ("part", "bucket")


class TooManySegments(ValueError):
    pass


SPARK_TYPE = {"string": T.StringType(), "bytes": T.BinaryType(), "bool": T.BooleanType(), "float": T.DoubleType(), "double": T.DoubleType()}


def extracted(records: DataFrame, cfg: IndexConfig, json: str | None = None) -> DataFrame:
    """records with field_<name> for every declared field, null where the path leads nowhere.

    json names a column of JSON texts to look in; records that are no JSON are dropped.
    """
    if json is not None:
        # a row each by explode, as no filter is pushed below it: one on fields would hold the parsing once for each of their uses
        parsed = records.withColumn("__json", F.explode(F.array(F.try_parse_json(F.col(json).cast("string"))))).where("__json IS NOT NULL")
        return parsed.withColumns({f"field_{n}": coerce_json(F.col("__json"), f.path, f.type) for n, f in cfg.fields.items()}).drop("__json")
    out = {}
    for name, f in cfg.fields.items():
        found = at_path(records.schema, f.path)
        out[f"field_{name}"] = F.lit(None).cast(SPARK_TYPE.get(f.type, T.LongType())) if found is None else coerce(*found, f.type)
    return records.withColumns(out)


def event_time(records: DataFrame, cfg: IndexConfig, source_ms: Column) -> Column:
    """Milliseconds of the time field by its unit; the source's time where there is none."""
    if cfg.timeField is None:
        return source_ms
    spec = cfg.fields[cfg.timeField]
    native = at_path(records.schema, spec.path)
    if native and isinstance(native[1], (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return event_ms(*native, None, source_ms)
    kind = T.LongType() if spec.type in INTEGERS else SPARK_TYPE[spec.type]
    return event_ms(F.col(f"field_{cfg.timeField}"), kind, spec.unit, source_ms)


def aligned(ms: Column, cfg: IndexConfig) -> Column:
    """Start of the bucket: the remainder is taken off towards zero. Without alignment, the time itself."""
    return ms if cfg.segmentation.alignment == "none" else ms - ms % F.lit(cfg.bucket_ms)


def dimension(cfg: IndexConfig, dim: Dimension) -> Column:
    value = F.col(f"field_{dim.field}")
    kind = cfg.fields[dim.field].type
    if dim.bucket is not None:
        number = value.try_cast("double") if kind == "string" else value.cast("double") if kind != "bytes" else F.lit(None).cast("double")
        value = bucketed(number, dim.bucket)
    if dim.numeric:
        return uint32(value.try_cast("bigint") if kind == "string" and dim.bucket is None else value.cast("bigint"))
    return hashed(value, dim.encoding, dim.hashAlgo) if dim.hashed else value.cast("string")


def cells(records: DataFrame, cfg: IndexConfig, part: Column, offset: Column, source_ms: Column | None = None, json: str | None = None) -> DataFrame:
    """Cells of records that have a member; offset gives the order of records in a part."""
    rows = extracted(records.withColumns({"__part": part.cast("int"), "__offset": offset.cast("bigint"), "__source": (F.lit(None) if source_ms is None else source_ms).cast("bigint")}), cfg, json)
    rows = rows.withColumn("ts_ms", event_time(rows, cfg, F.col("__source")))
    member = F.col(f"field_{cfg.member.field}")
    if cfg.member.encoding == "raw_uint32":
        member = uint32(member.cast("bigint") if cfg.fields[cfg.member.field].type in INTEGERS else member.try_cast("bigint"))
    elif cfg.fields[cfg.member.field].type == "bytes":
        member = F.hex(member)
    if cfg.member.encoding == "hash64":
        member = F.when(member.isNotNull(), F.xxhash64(member.cast("string")))
    last = {f"raw_{n}": F.when(F.col(f"field_{cfg.dimension(n).field}").cast("double").between(0, UINT32), F.col(f"field_{cfg.dimension(n).field}").cast("double").cast("bigint")) for n in cfg.experimentalModels.bsiDims}
    kept = sorted({m.field for m in cfg.metrics if m.field})
    out = rows.select(
        F.col("__part").alias("part"), aligned(F.col("ts_ms"), cfg).alias("bucket"), F.col("__offset").alias("offset"), "ts_ms", member.alias("member"), F.col(f"field_{cfg.member.field}").cast("string").alias("member_key"),
        *[dimension(cfg, d).alias(f"dim_{d.name}") for d in cfg.dimensions], *[c.alias(n) for n, c in last.items()], *[F.col(f"field_{n}") for n in kept],
    )
    out = out.where(F.col("member").isNotNull() & F.col("bucket").isNotNull())
    out = reduce(lambda df, d: guarded(df, f"dim_{d.name}", d.maxCardinality, d.onOverflow, not d.numeric and not d.hashed), [d for d in cfg.dimensions if d.maxCardinality is not None], out)
    book = cfg.member.dict
    if cfg.member.encoding != "dict" or book is None or book.maxSize is None:
        return out
    text = dict(out.dtypes)["member"] == "string"
    return guarded(out, "member", book.maxSize, book.onOverflow, text).where(F.col("member").isNotNull())


def first_seen(df: DataFrame, column: str) -> DataFrame:
    """(part, bucket, value, nth): the values of a column in each segment in order of first appearance."""
    seen = df.where(F.col(column).isNotNull()).groupBy(*SEGMENT, F.col(column).alias("value")).agg(F.min("offset").alias("first"))
    return seen.select(*SEGMENT, "value", F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("first", "value")).alias("nth"))


def guarded(df: DataFrame, name: str, most: int, on_overflow: str, text: bool) -> DataFrame:
    """df with at most so many values of a column in each segment, those seen first.

    Others become null (reject) or, of texts, one value of their own (overflow), or stop the job (halt).
    """
    late = first_seen(df, name).where(F.col("nth") > most).select(F.col("part").alias("__p"), F.col("bucket").alias("__b"), F.col("value").alias("__late"))
    same = F.col("part").eqNullSafe(F.col("__p")) & F.col("bucket").eqNullSafe(F.col("__b")) & (F.col(name) == F.col("__late"))
    joined = df.join(late, same, "left")
    over = F.col("__late").isNotNull()
    if on_overflow == "halt":
        message = F.lit(f"{name.removeprefix('dim_')} has more than {most} values in a segment")
        value = F.when(over, F.raise_error(message).cast(df.schema[name].dataType)).otherwise(F.col(name))
    else:
        value = F.when(over, F.lit(OTHER) if on_overflow == "overflow" and text else F.lit(None)).otherwise(F.col(name))
    return joined.withColumn(name, value.cast(df.schema[name].dataType)).select(*df.columns)


def overflow_counts(df: DataFrame, dim: Dimension) -> DataFrame:
    """(part, bucket, accepted, overflowed) values of a dimension that df holds before the guard."""
    seen = first_seen(df, f"dim_{dim.name}")
    return seen.groupBy(*SEGMENT).agg(F.count_if(F.col("nth") <= dim.maxCardinality).alias("accepted"), F.count_if(F.col("nth") > dim.maxCardinality).alias("overflowed"))


def pruned(df: DataFrame, cfg: IndexConfig, start: int | None = None, end: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
    """Whole segments that overlap [start, end) in the given parts; records are never cut by their own time."""
    if end is not None:
        df = df.where(F.col("bucket") < F.lit(end))
    if start is not None:
        df = df.where(F.col("bucket") > F.lit(start - cfg.bucket_ms))
    parts = list(parts or [])
    return df.where(F.col("part").isin(parts)) if parts else df


def values(cfg: IndexConfig) -> Column:
    """The values of a record's dimensions: (dim, value as text, code as a number)."""
    return F.array(*[F.struct(F.lit(d.name).alias("dim"), F.col(f"dim_{d.name}").cast("string").alias("value"), (F.col(f"dim_{d.name}") if d.numeric or d.hashed else F.lit(None)).cast("bigint").alias("code")) for d in cfg.dimensions])


def postings(df: DataFrame, cfg: IndexConfig, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """(segment, member, dim, value, code), distinct: which members have a value of a dimension."""
    rows = df.select(*keys, "member", F.explode(values(cfg)).alias("p")).select(*keys, "member", "p.*")
    return rows.where(F.col("value").isNotNull()).distinct()


def listed(base: DataFrame, pairs: DataFrame, cfg: IndexConfig, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """A row for each segment of base, which has its records and offsets, with its distinct values of every dimension, from pairs (dim, value)."""
    counted = pairs.distinct().groupBy(*keys).agg(*[F.count_if(F.col("dim") == d.name).alias(f"values_{d.name}") for d in cfg.dimensions])
    out = base.join(counted, list(keys), "left")
    return out.select(
        F.concat_ws("-", F.lit("p").alias("p"), "part", "bucket").alias("id"), *[k for k in keys if k not in SEGMENT], "part", F.col("bucket").alias("start_ms"), (F.col("bucket") + F.lit(cfg.bucket_ms)).alias("end_ms"), "records", "first_offset", "last_offset",
        *[F.coalesce(f"values_{d.name}", F.lit(0)).cast("bigint").alias(f"values_{d.name}") for d in cfg.dimensions],
    )


def catalog(df: DataFrame, cfg: IndexConfig, keys: Sequence[str] = SEGMENT) -> DataFrame:
    """A row for each segment: id, times, records, offsets and distinct values of every dimension."""
    base = df.groupBy(*keys).agg(F.count("*").alias("records"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    pairs = df.select(*keys, F.explode(values(cfg)).alias("p")).where("p.value IS NOT NULL").select(*keys, "p.dim", "p.value")
    return listed(base, pairs, cfg, keys)


def dimension_cardinality(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """(dim, values): distinct values of each dimension over all segments."""
    return postings(df, cfg).select("dim", "value").distinct().groupBy("dim").agg(F.count("*").alias("values"))
