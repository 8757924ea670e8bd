"""Helpers that the operators share: table access, scratch tables in the shared folder, ordered blocks."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 100_000
"""A table of short rows is broadcast only if a count shows that it has at most so many rows."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; where that is unset, as in tests, one in the warehouse, which they see, too."""
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return path.rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    mark = ""
    while any((n + mark).lower() in taken for n in names):
        mark += "_"
    return [n + mark for n in names]


def store(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cohortlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Deletes what store() wrote, once nothing that is still lazy reads it."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for name in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.getName().startswith("cohortlake-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now rather than at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; counts no further."""
    return df.limit(rows + 1).count() <= rows


def shuffled(df: DataFrame) -> DataFrame:
    """Marks df so that a join with it shuffles (AQE splits skew). By its own estimate, which is far too low after an explode or of packed files, Spark might broadcast either side through the driver."""
    return df.hint("merge")


def joinable(df: DataFrame) -> DataFrame:
    """Marks df for broadcast if a count proves it small, otherwise for a shuffle."""
    return F.broadcast(df) if few(df) else shuffled(df)


SALTS = 32
"""A key's rows are dealt over so many tasks at least."""
SALT_ROWS = 20_000_000
"""A table of more rows than SALTS times this is dealt over more, so that a key with a third of all rows gives no task more than some SALT_ROWS."""


def salts(rows: int) -> int:
    return max(SALTS, -(-rows // (3 * SALT_ROWS)))


def hub_join(many: DataFrame, one: DataFrame, key: str, rows: int = 0) -> DataFrame:
    """many (of about so many rows) joined with the one row of each key: by broadcast if a count proves one small, else
    with the rows of a key dealt over salts(rows) tasks and one repeated for each, so that a key with a large share of many is split.

    one is a stored table, as the count and the join both read it."""
    if few(one):
        return many.join(F.broadcast(one), key)
    n = salts(rows)
    salted = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(n)))
    repeated = one.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return salted.join(shuffled(repeated), [key, "__salt"]).drop("__salt")


def blocks(df: DataFrame, order: list[Column], name: str = "__blk") -> DataFrame:
    """Stores df with the number of its range partition. Ranges are split wherever order differs, so no key is held together."""
    return store(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id().cast("long")))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums in a global order, without putting all rows into one task.

    Each range partition sums its own rows; the totals of earlier partitions, one row for each
    partition, are broadcast. Rows that tie in order get their sums in any order among them.
    """
    cut = blocks(df, order)
    totals = cut.groupBy("__blk").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__blk", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums])
    inside = Window.partitionBy("__blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cut.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()]).join(F.broadcast(totals), "__blk")
    return out.withColumns({n: (F.col(n) + F.col(f"__t_{n}")).cast("long") for n in sums}).drop("__blk", *[f"__t_{n}" for n in sums])
