"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are scaled to integers, dealt evenly over tasks and stored. Queries are few beside the
rows; they are sent to the tasks in groups of at most GROUP_BYTES, so the rows stay where they are
and are read once for each group. A task takes its rows in blocks of BLOCK. In a block, every
dimension has its list of rows in order of the component. For a query the lists are read in
step, from the top where the query's component is positive and from the bottom where it is
negative; rows seen for the first time are scored in full. The sum over lists of the query's
component times the next value bounds every row that has not been seen; reading stops when that
bound is below the kth best score so far, which a task carries from block to block, so that later
blocks stop early or are not read at all. The best k of each task are merged by query.

Cases: vectors that are null or empty, or hold a null or a component that is not finite, take no
part, nor do null ids; a query does not find rows of its own id; only vectors of the query's
dimension are candidates; ties go to the smaller id; repeated rows of one id are one candidate
each, and each query row has a list of its own, so that of a row that is repeated comes as often;
fewer than k candidates give fewer rows. Scaled components and scores that no long can hold are
the least or the largest long. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import store

SCALE = 1024
K = 10
EVERY = 100
BLOCK = 8192
GROUP_BYTES = 16 << 20
"""Bytes of query vectors that are held by the driver and broadcast at once."""
TASK_ROWS = 1 << 18
EXACT, LONG = float(1 << 53), (1 << 63) - 1


class Lists:
    """The rows of a block in order of each component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(vectors.T, self.order, axis=1)
        self.largest = max(abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0))))
        self.floats = vectors.astype(np.float64)

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        most = self.largest * max(abs(int(query.max(initial=0))), abs(int(query.min(initial=0)))) * len(query)
        if most < EXACT:
            return (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)  # every partial sum is an exact integer
        if most <= LONG:
            return self.vectors[rows] @ query
        whole = self.vectors[rows].astype(object) @ query.astype(object)
        return np.array([_held(x) for x in whole], np.int64)

    def top(self, own: int, query: np.ndarray, k: int, ids: np.ndarray | None = None, scores: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k of those given and the rows of the block, ties to the smaller id."""
        n, used = len(self.ids), np.flatnonzero(query)
        ids, scores = (np.zeros(0, np.int64) if x is None else x for x in (ids, scores))
        weight, down = query[used], query[used] > 0
        seen = np.zeros(n, bool)
        depth, step = 0, 64
        while depth < n:
            # no row that is left can be above this
            ahead = np.where(down, self.sorted[used, n - 1 - depth], self.sorted[used, depth])
            bound = _held(sum(a * b for a, b in zip(weight.tolist(), ahead.tolist(), strict=True)))
            if len(ids) == k and bound < scores[-1]:
                break
            upto = min(n, depth + step) if len(used) else n
            fresh = np.full(n, not len(used))
            for d, up in zip(used, down, strict=True):
                fresh[self.order[d, n - upto : n - depth] if up else self.order[d, depth:upto]] = True
            fresh = np.flatnonzero(fresh & ~seen)
            seen[fresh] = True
            found = fresh[self.ids[fresh] != own]
            ids, scores = np.concatenate([ids, self.ids[found]]), np.concatenate([scores, self.scores(found, query)])
            best = np.lexsort((ids, ~scores))[:k]  # the complement turns the order round and never overflows
            ids, scores = ids[best], scores[best]
            depth, step = upto, step * 2
        return ids, scores


def _held(x: int) -> int:
    return max(-LONG - 1, min(LONG, x))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _search(batches: Iterator[pa.RecordBatch], asked: list[tuple[int, int, np.ndarray]], k: int, block: int) -> Iterator[pa.RecordBatch]:
    """(id, dim, vector) rows -> the best k rows of this task for each (number, own id, vector) asked."""
    by: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for q in asked:
        by.setdefault(len(q[2]), []).append(q)
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    held: dict[int, list[pa.RecordBatch]] = {}

    def work(dim: int) -> None:
        rows = pa.Table.from_batches(held.pop(dim))
        lists = Lists(rows.column(0).to_numpy().astype(np.int64), _matrix(rows.column(2)))
        for number, own, vector in by[dim]:
            best[number] = lists.top(own, vector, k, *best.get(number, (None, None)))

    for batch in batches:
        dims = batch.column(1).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            if dim in by:
                own = batch.filter(pa.array(dims == dim))
                for lo in range(0, own.num_rows, block):
                    held.setdefault(dim, []).append(own.slice(lo, block))
                    if sum(x.num_rows for x in held[dim]) >= block:
                        work(dim)
    for dim in list(held):
        work(dim)
    rows = [(number, int(i), int(s)) for number, (ids, scores) in best.items() for i, s in zip(ids, scores, strict=True)]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["number", "id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id, vector of long) and (query_id, vector) -> query_id, rank, id, score."""
    spark = vectors.sparkSession
    rows, cores = vectors.count(), spark.sparkContext.defaultParallelism
    tasks = max(1, -(-rows // TASK_ROWS), min(cores, -(-rows // 2048)))
    dealt = store(vectors.select("id", F.size("vector").alias("dim"), "vector").repartition(tasks))
    asked = store(queries.groupBy("query_id", "vector").agg(F.count("*").cast("int").alias("times")))
    size = asked.agg(F.coalesce(F.sum(F.size("vector") * F.lit(8)), F.lit(0)).alias("n")).first().n
    groups = max(1, math.ceil(size / group_bytes))
    out = None
    for g in range(groups):
        # a group is bounded by its bytes; its number tells a query from another of its id
        part = asked.where(F.pmod(F.xxhash64("query_id", "vector"), F.lit(groups)) == g).collect()
        names = spark.createDataFrame([(i, r.query_id, r.times) for i, r in enumerate(part)], "number long, query_id long, times int")
        shared = spark.sparkContext.broadcast([(i, r.query_id, np.array(r.vector, np.int64)) for i, r in enumerate(part)])
        found = dealt.mapInArrow(lambda it, shared=shared: _search(it, shared.value, k, block), "number long, id long, score long")
        order = Window.partitionBy("number").orderBy(F.desc("score"), "id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = ranked.join(F.broadcast(names), "number").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times"))))
        named = named.select("query_id", "rank", "id", "score")
        named = named if groups == 1 else store(named)
        out = named if out is None else out.unionByName(named)
    return out


def scaled(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) -> (id, vector): components floor(scale * x), without vectors that take no part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = embeddings.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(1 << 63))), F.lit(math.nextafter(float(1 << 63), 0)))).cast("long")
    return kept.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", whole).alias("vector"))


def neighbours(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For each row whose vec_id is divisible by every, its k nearest rows."""
    vectors = scaled(embeddings)
    queries = vectors.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")
    return search(vectors, queries, k).withColumnRenamed("id", "vec_id")


SQL = r"""
WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
