"""Mixing sources to target weights.

Tokens are summed for each source, targets are filled by weight with a ceiling of so many times
the source, and each document is emitted floor(rate) times plus one more time with the
probability of the fraction, by a coin seeded with its id. Only DataFrame functions run.

Cases: a null text has size 0; a null source is a source of its own, the last in order; a null
doc_id has a coin too (that of the word null); equal ids share a coin, so repeated rows are
repeated alike; an empty table gives an empty table; a source of size 0 has target and rate 0;
very long texts are counted whole; columns of any other name are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import joinable, running, store, unused

WEIGHTS = (5, 2, 1)
CEILING = 3
SEED = "mix"
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1, exclusive, that depends on the key and the seed alone."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size) -> the same with target.

    The sources in code point order weigh in turn as given. The level to which weight raises
    every target is found from running sums in the order of ceiling by weight: a source is at
    its ceiling if even the level over those from it on would put it above.
    """
    ranked = running(sizes, [F.col("source").isNull(), F.col("source")], {"__n": F.lit(1)})
    turn = F.pmod(F.col("__n") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "source_size", weight.alias("__w"), (ceiling * F.col("source_size")).alias("__cap"))
    order = [F.col("__cap") / F.col("__w"), F.col("source").isNull(), F.col("source")]
    summed = store(running(ranked, order, {"__c": F.col("__cap"), "__v": F.col("__w")}))
    whole = summed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t"), F.coalesce(F.sum("__w"), F.lit(0)).alias("w")).first()
    left, rest = F.lit(whole.t) - (F.col("__c") - F.col("__cap")), F.lit(whole.w) - (F.col("__v") - F.col("__w"))
    full = F.col("__cap") * rest < F.col("__w") * left
    held = summed.where(full).agg(F.coalesce(F.sum("__cap"), F.lit(0)).alias("c"), F.coalesce(F.sum("__w"), F.lit(0)).alias("w")).first()
    free = max(whole.w - held.w, 1)
    level = (F.col("__w") * F.lit(whole.t - held.c)).cast("double") / F.lit(float(free))
    return summed.select("source", "source_size", F.when(full, F.col("__cap").cast("double")).otherwise(level).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """row (the document with all its columns), doc_id, size, source_size, target and copies: how often the mix has the document."""
    sized = docs.select(F.struct("*").alias("row"), "doc_id", "source", size_of(F.col("text")).alias("size"))
    sizes = store(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = joinable(store(targets(sizes, weights, ceiling).withColumnRenamed("source", "of")))
    joined = sized.join(goal, sized["source"].eqNullSafe(goal["of"]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = (whole + F.when(coin(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("long")
    return joined.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as plan() says, with copy, its number from 1 (by a longer name if docs has that)."""
    (name,) = unused(docs, "copy")
    each = plan(docs, **how).where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
    return each.select("row.*", F.col("nth").alias(name))


def taken(docs: DataFrame, **how) -> DataFrame:
    """For each document, its size, its source's size and target, and the words that the mix takes of it."""
    return plan(docs.select("doc_id", "text", "source"), **how).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(3 * source_size AS BIGINT) AS cap, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s),
r AS (SELECT *, sum(cap) OVER o - cap AS cap_before, sum(weight) OVER o - weight AS weight_before, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cap * (weights - weight_before) < weight * (total - cap_before) AS is_full FROM r),
h AS (SELECT coalesce(sum(cap) FILTER (WHERE is_full), 0) AS caps, coalesce(sum(weight) FILTER (WHERE is_full), 0) AS held FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (total - caps) AS DOUBLE) / CAST(greatest(weights - held, 1) AS DOUBLE) END AS target FROM f, h),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
      CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0 AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM m
"""
