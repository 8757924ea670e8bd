"""Chat formatting by perspective rotation.

For every participant of a conversation (every role but system), the dialogue is rendered with
that participant as assistant and all others as named users; the mask holds the spans of the
assistant's words, closing mark included, as start:end in code points of the whole rendering. Only
DataFrame functions run.

A conversation of at most PART turns is one row: its turns are gathered once, and every
perspective is rendered from them. A longer one comes in parts of PART turns, numbered from 0, so
that no conversation, however long, is gathered in one task; its turns are ranked over range
partitions. The texts of its parts in order are the whole rendering: at is the place where a part
begins in it, and spans count from its beginning in every part.

Cases: turns are in order of turn, role, text, nulls first; ties and repeated rows are all
rendered; a null role is a user without a name and no participant; a null text is empty; a
conversation without participants gives no rows; null conv_ids are one conversation; in names,
%, |, <, > and ends of lines are escaped by % and their code, so different names stay apart; the
mark <| inside a text is broken up as < |; very long texts are rendered whole; extra columns are
not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import blocks, joinable, store

PART = 256
SYSTEM = "system"
ESCAPED = ("%", "|", "<", ">", "\n", "\r")
_ORDER = ["turn", "role", "text"]


def ranked(turns: DataFrame) -> DataFrame:
    """turns with __rank, from 0 in each conversation, by range partitions and the counts of earlier ones."""
    cut = blocks(turns, [F.col("conv_id"), *map(F.col, _ORDER)])
    counts = cut.groupBy("conv_id", "__blk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("conv_id").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("__c"), F.col("__blk").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = cut.withColumn("__rn", F.row_number().over(Window.partitionBy("__blk", "conv_id").orderBy(*_ORDER)))
    joined = inside.join(counts, (F.col("__blk") == F.col("__b")) & F.col("conv_id").eqNullSafe(F.col("__c")))
    return joined.withColumn("__rank", F.col("__before") + F.col("__rn") - 1).select("conv_id", *_ORDER, "__rank")


def _message(role: Column, text: Column, speaker: Column) -> tuple[Column, Column]:
    """Head and rest of a rendered turn."""
    name = reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit(f"%{ord(mark):02X}")), ESCAPED, role)
    user = F.when(role.isNull(), F.lit("<|user|>\n")).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    head = F.when(role == SYSTEM, F.lit("<|system|>\n")).when(role == speaker, F.lit("<|assistant|>\n")).otherwise(user)
    return head, F.concat(F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))


def _rendered(parts: DataFrame) -> DataFrame:
    """(conv_id, part, perspective, __turns) -> the rendering of each, and its __spans as [start, end]."""
    # each turn's head and rest are computed once, in a column of their own
    said = parts.withColumn("__said", F.transform("__turns", lambda t: F.struct((t["role"] == F.col("perspective")).alias("mine"), *[c.alias(n) for n, c in zip(("head", "rest"), _message(t["role"], t["text"], F.col("perspective")), strict=True)])))

    def add(state: Column, t: Column) -> Column:
        at = state["at"] + F.char_length(t["head"])
        end = at + F.char_length(t["rest"]) - 1
        span = F.when(t["mine"], F.array(F.array(at, end))).otherwise(F.array().cast("array<array<bigint>>"))
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], span).alias("spans"))

    text = F.array_join(F.transform("__said", lambda t: F.concat(t["head"], t["rest"])), "")
    spans = F.aggregate("__said", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("spans")), add)["spans"]
    return said.select("conv_id", "perspective", "part", F.size("__turns").cast("long").alias("n_turns"), text.alias("text"), spans.alias("__spans"))


def rotate(turns: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, perspective, part, n_turns, at, text, mask: the renderings of every conversation."""
    kept = turns.select("conv_id", *_ORDER)
    zero = F.lit(0).cast("long")
    long = store(kept.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > part).select(F.col("conv_id").alias("__long")))
    some = joinable(long)
    is_long = F.col("conv_id").eqNullSafe(F.col("__long"))
    short = kept.join(some, is_long, "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("t"), "turn", F.col("role").isNotNull().alias("r"), "role", F.col("text").isNotNull().alias("x"), "text"))).alias("__turns"))
    people = F.array_distinct(F.filter(F.transform("__turns", lambda t: t["role"]), lambda r: r.isNotNull() & (r != SYSTEM)))
    one = _rendered(short.select("conv_id", zero.alias("part"), "__turns", F.explode(people).alias("perspective")))
    out = one.withColumn("at", zero)
    if not long.isEmpty():
        theirs = kept.join(some, is_long, "left_semi")
        people = theirs.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("__c"), F.col("role").alias("perspective")).distinct()
        parts = ranked(theirs).groupBy("conv_id", F.floor(F.col("__rank") / part).cast("long").alias("part")).agg(F.array_sort(F.collect_list(F.struct("__rank", "role", "text"))).alias("__turns"))
        many = store(_rendered(parts.join(people, F.col("conv_id").eqNullSafe(F.col("__c")))))
        before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = many.select("conv_id", "perspective", "part", F.char_length("text").cast("long").alias("__n"))  # no texts meet in a window
        places = store(sizes.select(F.col("conv_id").alias("__c"), F.col("perspective").alias("__p"), F.col("part").alias("__k"), F.coalesce(F.sum("__n").over(before), zero).alias("at")))
        same = F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("perspective") == F.col("__p")) & (F.col("part") == F.col("__k"))
        out = out.unionByName(many.join(joinable(places), same).drop("__c", "__p", "__k"))
    mask = F.array_join(F.transform("__spans", lambda s: F.concat_ws(":", *[(F.col("at") + s[i]).cast("string") for i in (0, 1)])), ",")
    return out.select("conv_id", "perspective", "part", "n_turns", "at", "text", mask.alias("mask"))


SQL = r"""
WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS rank FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
m AS (SELECT r.conv_id, p.perspective, r.rank, r.rank // 256 AS part, r.role,
      CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>' WHEN role IS NULL THEN '<|user|>'
           ELSE '<|user name=' || replace(replace(replace(replace(replace(replace(role, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D') || '|>' END || chr(10) AS head,
      replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS rest
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(rest)) OVER (PARTITION BY conv_id, perspective ORDER BY rank) - length(rest) AS body FROM m)
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, CAST(min(body - length(head)) AS BIGINT) AS at, string_agg(head || rest, '' ORDER BY rank) AS text,
       coalesce(string_agg(CAST(body AS BIGINT) || ':' || CAST(body + length(rest) - 1 AS BIGINT), ',' ORDER BY rank) FILTER (WHERE role = perspective), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
