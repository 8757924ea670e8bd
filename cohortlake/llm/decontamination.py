"""Benchmark decontamination: test items inside long documents.

Items are partitioned by the size of their shingle set into powers of two. In the partition of
size s, documents are cut into windows of 2s shingles every s shingles, so an item lies whole in
some window and the Jaccard similarity of the two has a floor. The number of MinHash bands (of
one row) is chosen for each partition from that floor, so that a window that contains the least
wanted share of an item collides with it with a probability of at least COLLISION. A
band's order of shingles is that of their hashes mixed anew with its seed, so that bands are
independent. Minima over blocks are shared by the windows and the partitions. What collides is verified by the exact
share of the item's five-word shingles, as words, that the whole document has.

One pass over the documents serves PART items or PART_BYTES of them, which are broadcast; more
items than that are dealt into several parts by hash, and a pass is made for each.

Cases: null and empty texts on either side match nothing; items of fewer than five words are one
shingle of all their words, and match documents that are just that; repeated items and documents
match each for itself; very long documents are searched whole, their words in slices; extra
columns are kept or not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import mix, pieces, plain_shingles, shingles

CONTAINMENT = 0.8
COLLISION = 0.995
PART = 20_000
PART_BYTES = 32 << 20
SMALLEST = 4
_FILTER_BITS = 18


class Index:
    """The items of one part: bands of each size partition, and exact shingles."""

    def __init__(self, ids: list, texts: list[str | None], containment: float = CONTAINMENT, collision: float = COLLISION):
        self.ids, self.containment = ids, containment
        self.sets = [plain_shingles(t) for t in texts]
        hashed: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(ids)
        for lo, hi, buf, offsets in pieces(pa.array(texts, pa.large_string())):
            h, owner = shingles(buf, offsets)
            for i in range(lo, hi):
                hashed[i] = np.unique(h[owner == i - lo])
        by: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(hashed):
            if len(h):
                by[max(SMALLEST, 1 << (len(h) - 1).bit_length())].append(i)
        self.bands: dict[int, int] = {}
        self.values: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for size, items in sorted(by.items()):
            q = min(len(hashed[i]) for i in items)
            shared = max(1, math.ceil(containment * q))
            floor = shared / (2 * size + q - shared)
            bands = self.bands[size] = max(2, math.ceil(math.log(1 - collision) / math.log(1 - floor)))
            self.values[size] = []
            for seed in self.seeds(bands):
                value = np.array([mix(hashed[i] ^ seed).min() for i in items], np.uint64)
                order = np.argsort(value, kind="stable")
                near = np.zeros(1 << _FILTER_BITS, bool)
                near[(value >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
                self.values[size].append((near, value[order], np.array(items)[order]))
        self.sizes = sorted(by)

    @staticmethod
    def seeds(n: int) -> np.ndarray:
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def candidates(self, buf: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) whose MinHash bands collide in some window."""
        out: set[tuple[int, int]] = set()
        if not self.sizes:
            return out
        h, owner = shingles(buf, offsets)
        if not len(h):
            return out
        count = np.bincount(owner, minlength=len(offsets) - 1)
        least = self.sizes[0]
        per = -(-count // least)
        block = np.cumsum(per) - per
        place = np.arange(len(h)) - (np.cumsum(count) - count)[owner]
        slot = block[owner] * least + place
        text = np.repeat(np.arange(len(count)), per)
        nth = np.arange(len(text)) - block[text]
        for k, seed in enumerate(self.seeds(max(self.bands.values()))):
            grid = np.full(len(text) * least, np.iinfo(np.uint64).max, np.uint64)
            grid[slot] = mix(h ^ seed)
            low = grid.reshape(-1, least).min(1)
            at, number = text, nth
            for size in range(int(math.log2(least)), int(math.log2(self.sizes[-1])) + 1):
                if size > math.log2(least):  # blocks of twice the size, from the pairs of each text
                    even = np.flatnonzero(number % 2 == 0)
                    after = np.minimum(even + 1, len(low) - 1)
                    paired = (at[after] == at[even]) & (after > even)
                    low = np.where(paired, np.minimum(low[even], low[after]), low[even])
                    at, number = at[even], number[even] // 2
                if (1 << size) not in self.bands or k >= self.bands[1 << size]:
                    continue
                window = low.copy()
                same = at[1:] == at[:-1]
                window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                near, value, items = self.values[1 << size][k]
                hit = np.flatnonzero(near[(window >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
                left, right = np.searchsorted(value, window[hit], "left"), np.searchsorted(value, window[hit], "right")
                for w, i, j in zip(hit[right > left], left[right > left], right[right > left], strict=True):
                    out.update((int(at[w]), int(x)) for x in items[i:j])
        return out

    def matches(self, text: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the matches that are verified."""
        for lo, _, buf, offsets in pieces(text):
            by: dict[int, list[int]] = defaultdict(list)
            for t, item in sorted(self.candidates(buf, offsets)):
                by[t].append(item)
            for t, items in by.items():
                found = plain_shingles(text[lo + t].as_py(), wanted=set().union(*[self.sets[i] for i in items]))
                for item in items:
                    shared = len(self.sets[item] & found)
                    if shared >= self.containment * len(self.sets[item]) - 1e-9:
                        yield lo + t, item, shared


def parts(benchmark: DataFrame, part: int = PART, part_bytes: int = PART_BYTES) -> Iterator[list]:
    """The distinct items with how often each is there (times), at most about part of them and part_bytes of their texts at a time."""
    items = benchmark.groupBy("item_id", "text").agg(F.count("*").cast("int").alias("times"))
    whole = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size")).first()
    n = max(math.ceil(whole.n / part), math.ceil(whole["size"] / part_bytes))
    for k in range(n):
        yield (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()


def find(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, part: int = PART) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every document and item that match."""
    kept = docs.select("doc_id", "text")
    schema = T.StructType([kept.schema["doc_id"], benchmark.schema["item_id"]]).add("shared", "long").add("item_shingles", "long").add("containment", "double")
    kinds = [_arrow(f.dataType) for f in schema.fields]
    out = None
    for rows in parts(benchmark, part):
        index = docs.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], containment))
        times = [r.times for r in rows]

        def search(batches: Iterator[pa.RecordBatch], index=index, times=times) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [m for m in index.value.matches(batch.column(1)) for _ in range(times[m[1]])]
                size = [len(index.value.sets[i]) for _, i, _ in found]
                columns = [[batch.column(0)[r].as_py() for r, _, _ in found], [index.value.ids[i] for _, i, _ in found], [s for _, _, s in found], size, [s / n for (_, _, s), n in zip(found, size, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        found = kept.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, part: int = PART) -> DataFrame:
    """docs without those that contain an item."""
    names, out = docs.columns, docs.select(*[c for c in docs.columns if c != "text"], "text")
    for rows in parts(benchmark, part):
        index = docs.sparkSession.sparkContext.broadcast(Index([r.item_id for r in rows], [r.text for r in rows], containment))

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flags = np.ones(batch.num_rows, bool)
                flags[[r for r, _, _ in index.value.matches(batch.column(batch.num_columns - 1))]] = False
                yield batch.filter(pa.array(flags))

        out = out.mapInArrow(keep, out.schema)
    return out.select(*names)
