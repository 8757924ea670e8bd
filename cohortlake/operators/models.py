"""Other ways to evaluate a filter, side by side: last values, member samples, cohort profiles, reordered members."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortlake.functions.encoders import stable_fraction
from cohortlake.plans.config import IndexConfig
from cohortlake.plans.filters import Always, And, Filter, FilterError, Not, OneOf, Or, parse, ranges, within

from .cells import SEGMENT, pruned
from .queries import BUILT_IN, Engine, UnsupportedQuery, in_universe

MODELS = ("roaring", "bsi", "theta", "joint_profile", "reordered")


def model_list(text: str | None) -> list[str]:
    """Known models of a comma list in any case, in order of first mention; none means the canonical one."""
    names = [x.strip().lower() for x in (text or "").split(",")]
    known = list(dict.fromkeys(x for x in names if x in MODELS))
    return known or ["roaring"]


def last_values(df: DataFrame, dim: str) -> DataFrame:
    """(part, bucket, member, value): what each member had last in a segment."""
    kept = df.where(F.col(f"raw_{dim}").isNotNull())
    return kept.groupBy(*SEGMENT, "member").agg(F.max_by(f"raw_{dim}", "offset").alias("value"))


def last_value_count(df: DataFrame, dim: str, low: int | None, high: int | None) -> DataFrame:
    """One row: matched and result of the members whose last value is in [low, high]."""
    hits = last_values(df, dim).where(within(F.col("value"), low, high))
    return hits.agg(F.count("*").alias("matched"), F.count_distinct("member").alias("result"))


def last_value_sum(engine: Engine, dim: str, filter: str | None = None) -> DataFrame:
    """One row, result: the last values of the members that a filter finds, added over segments."""
    values = last_values(engine.cells, dim)
    return values.join(engine.members(filter), [*SEGMENT, "member"], "left_semi").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("result"))


def sampled(df: DataFrame, rate: float) -> DataFrame:
    """Cells of the members whose hash is under the rate."""
    return df.where(stable_fraction(F.col("member")) < F.lit(float(rate)))


def theta_estimate(engine: Engine, filter: str | None = None, rate: float | None = None) -> DataFrame:
    """One row: sample (members found in the sample) and result (sample by rate)."""
    rate = engine.cfg.experimentalModels.thetaSampleRate if rate is None else rate
    hits = Engine(sampled(engine.cells, rate), engine.cfg).members(filter, canonical=True)
    return hits.agg(F.count_distinct("member").alias("sample")).withColumn("result", F.floor(F.col("sample") / F.lit(float(rate))).cast("bigint"))


def signatures(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """(part, bucket, member, signature): the sorted set of a member's dimension values in a segment."""
    atoms = F.filter(F.array(*[F.struct(F.lit(d.name).alias("dim"), F.col(f"dim_{d.name}").cast("string").alias("value")) for d in cfg.dimensions]), lambda a: a["value"].isNotNull())
    rows = df.where(in_universe(cfg)).select(*SEGMENT, "member", F.explode(atoms).alias("atom"))
    return rows.groupBy(*SEGMENT, "member").agg(F.array_sort(F.collect_set("atom")).alias("signature"))


def profiles(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """(part, bucket, signature, members): the cohorts of each segment."""
    return signatures(df, cfg).groupBy(*SEGMENT, "signature").agg(F.count("*").alias("members"))


def _of_profile(tree: Filter) -> Column:
    if isinstance(tree, Always):
        return F.lit(True)
    if isinstance(tree, Not):
        return ~_of_profile(tree.inner)
    if isinstance(tree, And):
        return _of_profile(tree.left) & _of_profile(tree.right)
    if isinstance(tree, Or):
        return _of_profile(tree.left) | _of_profile(tree.right)
    if isinstance(tree, OneOf):
        return F.exists("signature", lambda a: (a["dim"] == tree.dim) & a["value"].isin(*tree.values))
    raise UnsupportedQuery("profiles have no ranges")


def profile_count(engine: Engine, filter: str | None = None) -> DataFrame:
    """One row: matched and result. The filter is evaluated on each distinct profile of a segment, then members are looked up."""
    members = signatures(engine.cells, engine.cfg).withColumn("profile", F.xxhash64("signature"))
    hits = members.select(*SEGMENT, "profile", "signature").distinct().where(_of_profile(parse(filter))).select(*SEGMENT, "profile")
    found = members.select(*SEGMENT, "profile", "member").join(hits, [*SEGMENT, "profile"], "left_semi")
    return found.agg(F.count("*").alias("matched"), F.count_distinct("member").alias("result"))


def permutation(df: DataFrame, cfg: IndexConfig) -> DataFrame:
    """(part, bucket, member, position): members of a segment in order of signature, so that cohorts lie together.

    A cohort begins after the members of all earlier ones; only a cohort's members are put in order together.
    """
    own = signatures(df, cfg)
    sizes = own.groupBy(*SEGMENT, "signature").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*SEGMENT).orderBy("signature").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*SEGMENT, "signature", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("begin"))
    nth = F.row_number().over(Window.partitionBy(*SEGMENT, "signature").orderBy("member"))
    numbered = own.select(*SEGMENT, "signature", "member", nth.alias("nth"))
    return numbered.join(begins, [*SEGMENT, "signature"]).select(*SEGMENT, "member", (F.col("begin") + F.col("nth") - 1).alias("position"))


def reordered_count(engine: Engine, filter: str | None = None) -> DataFrame:
    """One row: matched and result, by way of positions and back; they are of their segment, so members are counted, not positions."""
    places = permutation(engine.cells, engine.cfg)
    hits = engine.members(filter, canonical=True).join(places, [*SEGMENT, "member"]).select(*SEGMENT, "position")
    back = hits.join(places, [*SEGMENT, "position"])
    return back.agg(F.count("*").alias("matched"), F.count_distinct("member").alias("result"))


def why_not(cfg: IndexConfig, model: str, tree: Filter, agg: str) -> str | None:
    """Why a model cannot answer; None if it can."""
    allowed = {"roaring": None, "theta": ("cardinality",)}.get(model, BUILT_IN)
    if allowed is not None and agg not in allowed:
        return f"{model} has no {agg}"
    if model == "bsi":
        missing = [d for d in dict.fromkeys(ranges(tree)) if d not in cfg.experimentalModels.bsiDims]
        return f"missing BSI for dim(s): {', '.join(missing)}" if missing else None
    if model in ("theta", "joint_profile") and ranges(tree):
        return f"{model} has no ranges"
    if model == "theta" and not cfg.experimentalModels.thetaSample:
        return "theta is off"
    if model == "joint_profile" and not cfg.experimentalModels.jointProfile:
        return "joint_profile is off"
    if model == "reordered" and not cfg.experimentalModels.reorderMembers:
        return "reordered is off"
    return None


def compare(engine: Engine, models: str | Iterable[str], filter: str | None = None, agg: str = "cardinality", start: int | None = None, end: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
    """(model, supported, value, approx, error): a row for each model."""
    tree, cfg = parse(filter), engine.cfg
    part = Engine(pruned(engine.cells, cfg, start, end, parts), cfg)
    names = model_list(models if isinstance(models, str) else ",".join(models))
    out: DataFrame | None = None
    for name in names:
        approx, reason = name == "theta", why_not(cfg, name, tree, agg)
        try:
            if reason is None:
                if name == "theta":
                    found = theta_estimate(part, filter)
                elif name == "joint_profile":
                    found = profile_count(part, filter)
                elif name == "reordered":
                    found = reordered_count(part, filter)
                elif name == "bsi":
                    hits = part.hits(tree, keep_outside=True)
                    found = hits.agg(F.count("*").alias("matched"), F.count_distinct("member").alias("result"))
                else:
                    found = part.query(filter, agg, canonical=True)
                value = F.col("matched" if agg == "count" and "matched" in found.columns else "result").cast("double")
                row = found.select(F.lit(name).alias("model"), F.lit(True).alias("supported"), value.alias("value"), (F.col("approx") if "approx" in found.columns else F.lit(approx)).alias("approx"), F.lit(None).cast("string").alias("error"))
        except (UnsupportedQuery, FilterError) as e:
            reason = str(e)
        if reason is not None:
            row = engine.cells.sparkSession.range(1).select(F.lit(name).alias("model"), F.lit(False).alias("supported"), F.lit(None).cast("double").alias("value"), F.lit(approx).alias("approx"), F.lit(reason).alias("error"))
        out = row if out is None else out.unionByName(row)
    return out

