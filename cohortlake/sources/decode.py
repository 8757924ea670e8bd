"""Records from outside: JSON, Avro and Protobuf payloads, Kafka, files, and a synthetic stream."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.plans.config import IndexConfig


class MissingConnector(RuntimeError):
    pass


def decoded(raw: DataFrame, cfg: IndexConfig, avro_schema: str | None = None, descriptor: str | None = None, message: str | None = None) -> DataFrame:
    """raw with the payload in value decoded by the configured format. JSON stays text, and is looked into by path; Avro and Protobuf become columns."""
    kind = cfg.source.schemaRegistry.format if cfg.source.schemaRegistry else "json"
    if kind in ("json", "json-schema"):
        return raw.withColumn("value", F.col("value").cast("string"))
    try:
        if kind == "avro":
            from pyspark.sql.avro.functions import from_avro

            payload = from_avro("value", avro_schema, {"mode": "PERMISSIVE"})
        else:
            from pyspark.sql.protobuf.functions import from_protobuf

            payload = from_protobuf("value", message, descriptor, {"mode": "PERMISSIVE"})
        return raw.withColumn("__payload", payload).where("__payload IS NOT NULL").select(*[c for c in raw.columns if c != "value"], "__payload.*")
    except Exception as e:
        raise MissingConnector(f"{kind} needs its Spark module on the class path: {e}") from e


def kafka_options(cfg: IndexConfig, streaming: bool = True) -> dict[str, str]:
    """Options of Spark's Kafka source for the configured topic."""
    start = cfg.source.startOffset
    given = {"kafka.bootstrap.servers": cfg.source.bootstrap, "subscribe": cfg.source.topic, "kafka.group.id": cfg.source.consumerGroup, "failOnDataLoss": "false"}
    if start.startswith("timestamp:"):
        instant = datetime.datetime.fromisoformat(start.removeprefix("timestamp:").replace("Z", "+00:00"))
        instant = instant if instant.tzinfo else instant.replace(tzinfo=datetime.UTC)
        return given | {"startingTimestamp": str(int(instant.timestamp() * 1000))}
    return given | {"startingOffsets": start if streaming or start == "earliest" else "earliest"}


def from_kafka(rows: DataFrame) -> DataFrame:
    """Columns of Spark's Kafka source as value, part, offset, source_ms."""
    return rows.select("value", F.col("partition").alias("part"), "offset", F.unix_millis("timestamp").alias("source_ms"))


def kafka(spark: SparkSession, cfg: IndexConfig, streaming: bool = True, **options: str) -> DataFrame:
    """The configured topic: value, part, offset, source_ms. Needs Spark's Kafka module."""
    reader = spark.readStream if streaming else spark.read
    try:
        rows = reader.format("kafka").options(**kafka_options(cfg, streaming), **options).load()
    except Exception as e:
        raise MissingConnector(f"kafka needs its Spark module on the class path: {e}") from e
    return from_kafka(rows)


def json_files(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int = 1) -> DataFrame:
    """Text files of one JSON record a line: value."""
    if streaming:
        return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return spark.read.text(path)


def synthetic(spark: SparkSession, rows: int = 10_000_000, users: int = 500_000, paths: int = 20_000, hours: int = 12, parts: int = 4, seed: int = 42) -> DataFrame:
    """A skewed stream of web requests: users and paths by a power law, latencies log-normal, few errors."""
    draw = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))

    def pick(salt: str, shares: dict[str, float]):
        out, upto, u = F.lit(list(shares)[-1]), 1.0, draw(salt)
        for name, share in reversed(list(shares.items())):
            upto -= share
            out = F.when(u >= max(upto, 0.0), out) if out is None else F.when(u < upto + share, F.lit(name)).otherwise(out)
        return out

    user = F.floor(F.pow(draw("user"), F.lit(2.0)) * users).cast("bigint")
    # Countries, devices, plans and statuses that the benchmark's queries name
    return spark.range(rows).select(
        user.alias("userId"),
        pick("country", {"US": 0.3, "IN": 0.2, "BR": 0.12, "DE": 0.1, "GB": 0.08, "FR": 0.08, "ID": 0.05, "MX": 0.04, "RU": 0.02, "JP": 0.01}).alias("country"),
        pick("device", {"mobile": 0.6, "desktop": 0.3, "tablet": 0.1}).alias("device"),
        pick("os", {"Android": 0.45, "iOS": 0.25, "Windows": 0.2, "macOS": 0.07, "Linux": 0.03}).alias("os"),
        pick("plan", {"free": 0.8, "pro": 0.15, "enterprise": 0.05}).alias("plan"),
        pick("status", {"200": 0.9, "404": 0.06, "500": 0.02, "502": 0.01, "503": 0.006, "504": 0.004}).cast("bigint").alias("status"),
        F.concat(F.lit("/p/"), F.floor(F.pow(draw("path"), F.lit(3.0)) * paths)).alias("path"),
        F.floor(F.exp(F.lit(4.0) + F.randn(seed) * 0.8)).cast("bigint").alias("latency"),
        (F.lit(1_700_000_000_000) + F.floor(F.col("id").cast("double") / rows * hours * 3_600_000)).cast("bigint").alias("tsMs"),
        F.pmod(user, F.lit(parts)).cast("int").alias("part"),
        F.col("id").alias("offset"),
    )
