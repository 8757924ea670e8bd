"""N-gram Jaccard join of whole documents by a prefix tree, and the groups that its links make.

A document's set holds its distinct five-word shingles. Documents of equal sets are one class at
once. Over the classes:

1. Each shingle's frequency (in how many classes it is) gives the global order: rare first.
   Shingles are dealt into buckets by hash in packed form, some millions to a bucket. Shingles
   that a sample of the classes shows to be in a large share of all need no exact frequency, only
   a place at the end of the order, so they are not dealt out at all; no bucket holds the rows of
   a hot shingle.
2. Shingles of one class alone cannot be shared, so only a class's set size and its shared
   shingles are kept. Two sets of Jaccard similarity t share one of the first n - ceil(t n) + 1
   shingles of each in the global order (prefix filter), and classes whose prefix has no shared
   shingle have no link.
3. Classes that share a prefix shingle are joined into families by connected components over
   stars, not pairs: every link lies inside a family.
4. In a family, sets are stored in a trie in the global order turned round, frequent first, where
   copies share most of their path. Each set walks the trie; nodes carry the overlap of the path so
   far, and a subtree is pruned when the overlap plus what can remain of the set and of the sets
   below cannot reach what the sizes demand. Sets that are linked already are skipped at the leaf.
5. A family of more than BLOCK sets is split into blocks by hash. Each block is joined alone, then
   one set for each group found. So a large group of near copies costs one trie a block. Last, the
   sets of each prefix shingle that several components have meet, again in blocks: those outside
   the shingle's largest component are held against all that have it, by bands of size. So no link
   between different components is lost, and sets meet only where they share a prefix shingle.

The query's result needs links only as far as they make components; links() of two sets are exact
integer comparisons of the sizes of intersection and union.

Cases: a text of fewer words than five is one shingle of all its words; null and wordless texts
have empty sets, and are linked with nothing, themselves included among copies; repeated rows of
one doc_id are each returned; a null doc_id is never the smallest of a group unless alone; extra
columns are not read. Shingles are compared by 64-bit hashes, of which the bucket's number and 40
bits are kept where they are dealt out: two sets of 200 shingles count one too many in common with a
chance of 4e-8 at most. Sets are told apart by two hashes of 64 bits; where two sets agree in the
first, the second names them. A very long text's words are hashed in slices.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import drop, few, free_shuffles, hub_join, joinable, salts, shuffled, store, unused
from ._text import mix, pieces, shingles

SIMILARITY = (80, 100)
BUCKET = 6_000_000
"""Shingles in a bucket, about: one task's memory is some 10 bytes for each, and 30 more for each that is shared."""
SLICES = 16
"""A bucket is sorted, and packed, in so many parts, one after the other."""
SETTLED = 100_000
"""A graph of at most so many edges is settled by one task, rather than by rounds of jobs."""
BLOCK = 256
SAMPLE = 64
"""One text in so many, by hash, is looked at for hot shingles."""
HOT_SHARE = 0.002
"""A shingle in more than this share of the sampled classes (and in HOT_LEAST of them) is hot; so there are at most the mean set size / HOT_SHARE."""
HOT_LEAST = 32
HOT_MOST = 1 << 23
"""A shingle in more classes than this is hot, whatever its share, so that a bucket's classes have numbers of CLASS_BITS bits."""
HOT = 255
CLASS_BITS = 24
BYTES = 5
"""Bytes of a shingle's hash that are dealt out; with the number of its bucket they tell it apart."""


def sets(buf: np.ndarray, offsets: np.ndarray, renamed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one text after the other in order of hash; texts' set sizes; two hashes of each set (0: empty).

    The first is replaced by the second where it is among renamed, which are in order.
    """
    h, text = shingles(buf, offsets)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
        h, text = h[keep], text[keep]
    n = np.bincount(text, minlength=len(offsets) - 1).astype(np.int64)
    names = [np.zeros(len(n), np.uint64) for _ in range(2)]
    if len(h):
        full = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[full]
        for name, seed in zip(names, (0x5851F42D4C957F2D, 0x14057B7EF767814F), strict=True):
            name[full] = mix(np.add.reduceat(mix(h ^ np.uint64(seed)), at) + n[full].astype(np.uint64)) | np.uint64(1)
    sid, other = names
    if renamed is not None and len(renamed):
        at = np.minimum(np.searchsorted(renamed, sid), len(renamed) - 1)
        sid = np.where(renamed[at] == sid, other, sid)
    return h, n, sid, other


def _digest(batches: Iterator[pa.RecordBatch], renamed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offsets in pieces(batch.column(1)):
            _, n, sid, other = sets(buf, offsets, renamed)
            ids = [pa.array(x.view(np.int64), mask=n == 0) for x in (sid, other)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *ids], ["doc_id", "n", "sid", "other"])


def digests(docs: DataFrame, renamed: np.ndarray | None = None) -> DataFrame:
    """doc_id, n (set size), sid and other (hashes of the set, null if empty)."""
    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(lambda it: _digest(it, renamed), kept.select("doc_id").schema.add("n", "long").add("sid", "long").add("other", "long"))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def hot_shingles(docs: DataFrame, classes: int, sample: int = SAMPLE, share: float = HOT_SHARE, least: int = HOT_LEAST) -> np.ndarray:
    """Shingles in many of the sampled classes, in order of hash; a bounded number of them."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in pieces(batch.column(0)):
                h, n, sid, _ = sets(buf, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(sid, n).view(np.int64))], ["h", "sid"])

    chosen = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    limit = min(max(least, math.ceil(share * classes / sample)), HOT_MOST // sample)
    found = chosen.mapInArrow(pick, "h long, sid long").distinct().groupBy("h").count().where(F.col("count") >= limit)
    return np.sort(found.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _low(h: np.ndarray) -> bytes:
    """The low BYTES bytes of each number."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def _high(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def _counts(n: np.ndarray) -> bytes:
    return n.astype(np.uint16 if n.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def _counted(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32)


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """All bytes of a binary column without nulls, in place, chunk by chunk."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(chunk.type) else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else [0]
        out.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8))
    return out


def _record(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("bucket", "salt", "g") else pa.binary()) for n, c in zip(names, columns, strict=True)], names)


def _deal(batches: Iterator[pa.RecordBatch], buckets: int, hot: np.ndarray, renamed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed shingles for each bucket and piece of text: BYTES bytes of each, class ids, and how many each has.

    A shingle is told by its bucket and those bytes. Hot ones have bucket -1 - theirs, and a salt that keeps pieces apart.
    """
    for batch in batches:
        for _, _, buf, offsets in pieces(batch.column(0)):
            h, n, sid, _ = sets(buf, offsets, renamed)
            _, first = np.unique(sid, return_index=True)
            chosen = np.zeros(len(sid), bool)
            chosen[first] = n[first] > 0
            h, sid, n = h[np.repeat(chosen, n)], sid[chosen], n[chosen]
            owner = np.repeat(np.arange(len(sid)), n)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                bucket = np.where(hot[at] == h, -1 - bucket, bucket)
            order = np.argsort(bucket, kind="stable")
            h, owner, bucket = (h // np.uint64(buckets))[order], owner[order], bucket[order]
            cut = _runs(bucket)
            rows = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                own = _runs(owner[lo:hi])
                salt = int(h[0] % np.uint64(1 << 30)) if bucket[lo] < 0 else 0
                rows.append((int(bucket[lo]), salt, _low(h[lo:hi]), sid[owner[lo:hi][own[:-1]]].tobytes(), _counts(np.diff(own))))
            yield _record(rows, _DEALT)


_DEALT = ["bucket", "salt", "h", "sid", "count"]
_PACKED = ["g", "bucket", "h", "df", "sid", "count", "n"]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'long' if n in ('bucket', 'salt', 'g') else 'binary'}" for n in names)


def _unpack(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and the class of each, over all rows."""
    h, owners = [], []
    for data, sid, count in zip(*[table.column(c).to_pylist() for c in ("h", "sid", "count")], strict=True):
        ids = np.frombuffer(sid, np.uint64)
        h.append(_high(data))
        owners.append(np.repeat(ids, _counted(count, len(ids))))
    return np.concatenate([np.zeros(0, np.uint64), *h]), np.concatenate([np.zeros(0, np.uint64), *owners])


def _group(sid: np.ndarray, groups: int) -> np.ndarray:
    return ((sid >> np.uint64(8)) % np.uint64(groups)).astype(np.int64)


def _pack(bucket: int, h: np.ndarray, df: np.ndarray, sid: np.ndarray, groups: int) -> list[tuple]:
    """Shared shingles of a bucket by group of classes."""
    group = _group(sid, groups)
    order = np.lexsort((sid, group))
    h, df, sid, group = h[order], df[order], sid[order], group[order]
    cut = _runs(group)
    rows = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = _runs(sid[lo:hi])
        rows.append((int(group[lo]), bucket, _low(h[lo:hi]), df[lo:hi].tobytes(), sid[lo:hi][own[:-1]].tobytes(), _counts(np.diff(own)), b""))
    return rows


def _rank(df: np.ndarray) -> np.ndarray:
    """Frequencies in eighths of a power of two, below HOT."""
    return np.minimum(np.log2(df) * 8, HOT - 1).astype(np.uint8)


def _shared(h: np.ndarray, number: np.ndarray, bits: int = CLASS_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct (40 bits of a shingle, number of a class), those whose shingle has several classes, in order, and how many that are."""
    if int(number.max(initial=0)) >> bits:
        order = np.lexsort((number, h))
        h, number = h[order], number[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (number[1:] != number[:-1])])
        h, number = h[keep], number[keep]
    else:  # the two make one number, which is sorted in place
        key = h << np.uint64(bits)
        key |= number.astype(np.uint64)
        key.sort()
        key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
        h, number = key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    size = np.diff(_runs(h))
    many = np.repeat(size > 1, size)
    return h[many], number[many], np.repeat(size[size > 1], size[size > 1])


def _met(table: pa.Table, groups: int) -> list[tuple]:
    """The packed shingles of a bucket that several classes share. It is worked on in slices by hash, so that only the shared ones are ever unpacked together."""
    bucket = table.column("bucket")[0].as_py()
    ids = [np.frombuffer(x, np.uint64) for x in table.column("sid").to_pylist()]
    counts = [_counted(c, len(i)) for i, c in zip(ids, table.column("count").to_pylist(), strict=True)]
    known, number = np.unique(np.concatenate(ids), return_inverse=True)
    owner = np.repeat(number.astype(np.uint32), np.concatenate(counts))
    del ids, counts, number
    low, at = [], 0
    for view in _views(table.column("h")):
        low.append((view.reshape(-1, BYTES), owner[at : at + len(view) // BYTES]))
        at += len(view) // BYTES
    found = []
    for part in range(SLICES):
        mine = [(x, o, x[:, 0] % SLICES == part) for x, o in low]
        h, of, size = _shared(_high(b"".join(x[m].tobytes() for x, _, m in mine)), np.concatenate([o[m] for _, o, m in mine]))
        found.append((h, of.astype(np.uint32), _rank(size)))
    del low, owner, mine
    h, of, df = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    part, rows = _group(known, groups) % SLICES, []
    for i in range(min(SLICES, groups)):
        mine = (part == i)[of]
        rows += _pack(bucket, h[mine], df[mine], known[of[mine]], groups)
    return rows


def shared_sets(docs: DataFrame, classes: DataFrame, total: int, count: int, similarity: tuple[int, int] = SIMILARITY, bucket: int = BUCKET, renamed: np.ndarray | None = None) -> DataFrame:
    """(sid, n, tokens, prefix) of the classes that may have a link: set size, shared shingles as packed
    64-bit numbers in the global order from rare to frequent, and how many of them are in the prefix."""
    hot = hot_shingles(docs, count)
    buckets = max(1, math.ceil(total / bucket))
    groups = 4 * buckets
    shared = docs.sparkSession.sparkContext.broadcast((hot, renamed))
    dealt = docs.select("text").mapInArrow(lambda it: _deal(it, buckets, *shared.value), _schema(_DEALT))

    def meet(table):
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            h, sid = _unpack(table)
            return pa.Table.from_batches([_record(_pack(-1 - bucket, h, np.full(len(h), HOT, np.uint8), sid, groups), _PACKED)])
        return pa.Table.from_batches([_record(_met(table, groups), _PACKED)])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "n"))
            group = _group(sid.view(np.uint64), groups)
            yield _record([(int(g), 0, b"", b"", sid[group == g].tobytes(), b"", n[group == g].astype(np.uint32).tobytes()) for g in np.unique(group)], _PACKED)

    packed = dealt.groupBy("bucket", "salt").applyInArrow(meet, _schema(_PACKED))
    packed = packed.unionByName(classes.select("sid", "n").mapInArrow(sizes, _schema(_PACKED)))
    num, den = similarity

    def gather(table):
        named = pa.compute.greater(pa.compute.binary_length(table.column("n")), 0)
        known, table = table.filter(named), table.filter(pa.compute.invert(named))
        ids = np.frombuffer(b"".join(known.column("sid").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(known.column("n").to_pylist()), np.uint32).astype(np.int64)
        order = np.argsort(ids)
        ids, n = ids[order], n[order]
        h, sid = _unpack(table)
        each = [len(x) // BYTES for x in table.column("h").to_pylist()]
        h = h * np.uint64(buckets) + np.repeat(np.array(table.column("bucket").to_pylist(), np.uint64), each)
        df = np.frombuffer(b"".join(table.column("df").to_pylist()), np.uint8)
        order = np.lexsort((h, df, sid))
        h, sid = h[order], sid[order]
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])]) if len(h) else np.zeros(0, bool)  # hot ones come once a piece
        h, sid = h[keep], sid[keep]
        cut = _runs(sid)
        rows = []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            size = int(n[np.searchsorted(ids, sid[lo])])
            prefix = int(hi - lo) - -(-num * size // den) + 1
            if prefix > 0:
                rows.append((int(sid[lo].view(np.int64)), size, h[lo:hi].tobytes(), prefix))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int32())], ["sid", "n", "tokens", "prefix"])

    return packed.groupBy("g").applyInArrow(gather, "sid long, n long, tokens binary, prefix int")


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow, over all edges (a, b) of a graph: (node, label). Labels are places among the nodes in order, and roots whenever edges are looked at."""
    sides = [np.zeros((2, 0), np.int64), *[np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]]
    nodes, at = np.unique(np.concatenate(sides, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def components(edges: DataFrame, settled: int = SETTLED) -> DataFrame:
    """(node, label) of the nodes that (a, b) joins: the label is the least node. By alternating stars, each round of which halves chains at least; at most settled edges go to one task."""
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    summed = lambda e: e.select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    edges = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = summed(edges)
    while True:
        if before.n <= settled:
            return edges.coalesce(1).mapInArrow(_settle, "node long, label long")
        # large star: of every node, the larger neighbours are tied to its least neighbour or itself
        sides = both(edges)
        least = store(sides.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = hub_join(sides, least, "a", 2 * before.n).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours and the node are tied to the least of them
        down = store(large.where("a <> b").distinct())
        lowest = store(down.groupBy("a").agg(F.min("b").alias("m")))
        small = hub_join(down, lowest, "a", 2 * before.n)
        new = store(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        drop(edges, least, down, lowest)
        after = summed(new)
        edges = new
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = after


class Groups:
    """Union of the sets that are linked."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def of(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.of(x), self.of(y)
        self.parent[max(x, y)] = min(x, y)


class Node:
    """A trie node: the run of tokens that leads to it, its children by first token, the sets that end in it, and the range of sizes and tokens below."""

    __slots__ = ("children", "ends", "largest", "most", "run", "smallest")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.smallest, self.largest, self.most = 1 << 60, 0, 0  # tokens are counted from the root


class Trie:
    """Sets of token numbers in ascending order, with shared runs stored once."""

    def __init__(self, similarity: tuple[int, int]):
        self.root, (self.num, self.den) = Node(np.zeros(0, np.int64)), similarity

    def add(self, tokens: np.ndarray, size: int, name: int) -> None:
        node, at = self.root, 0
        self._note(node, size, len(tokens))
        while at < len(tokens):
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = Node(tokens[at:])
                node.children[int(tokens[at])] = child
                at = len(tokens)
            else:
                k = min(len(child.run), len(tokens) - at)
                differ = np.flatnonzero(child.run[:k] != tokens[at : at + k])
                k = int(differ[0]) if len(differ) else k
                if k < len(child.run):  # the run is cut where the sets part
                    upper = Node(child.run[:k])
                    upper.smallest, upper.largest, upper.most = child.smallest, child.largest, child.most
                    child.run = child.run[k:]
                    upper.children[int(child.run[0])] = child
                    node.children[int(upper.run[0])] = upper
                    child = upper
                at += k
            self._note(child, size, len(tokens))
            node = child
        node.ends.append((name, size))

    @staticmethod
    def _note(node: Node, size: int, tokens: int) -> None:
        node.smallest, node.largest, node.most = min(node.smallest, size), max(node.largest, size), max(node.most, tokens)

    def linked(self, a: int, b: int, shared: int) -> bool:
        return self.den * shared >= self.num * (a + b - shared)

    def visit(self, has: np.ndarray, mine: np.ndarray, size: int, found) -> None:
        """Calls found(name) for every set that links. has: which tokens the walker has; mine: how many of them up to each token."""
        total = int(mine[-1]) if len(mine) else 0
        stack = [(self.root, 0, 0)]
        while stack:
            node, shared, depth = stack.pop()
            # no set below may be too small or too large, whatever it shares
            if self.den * node.largest < self.num * size or self.den * size < self.num * node.smallest:
                continue
            if len(node.run):
                shared += int(np.count_nonzero(has[node.run]))
                depth += len(node.run)
                rest = total - int(mine[node.run[-1]])
                best = shared + min(rest, node.most - depth)
                if not self.linked(size, max(node.smallest, best), best):
                    continue
            for name, other in node.ends:
                if self.linked(size, other, shared):
                    found(name)
            stack += [(child, shared, depth) for child in node.children.values()]


def join(tokens: list[np.ndarray], sizes: list[int], left: list[int], right: list[int] | None, groups: Groups, similarity: tuple[int, int]) -> None:
    """Joins in groups the sets of left that link with each other, or with those of right if given."""
    use = left + (right or [])
    every, inverse = np.unique(np.concatenate([tokens[i] for i in use]), return_inverse=True)
    often = np.bincount(inverse, minlength=len(every))
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -often))] = np.arange(len(every))  # frequent first: copies share most of their path
    ends = np.cumsum([len(tokens[i]) for i in use])
    local = {i: np.sort(rank[inverse[e - len(tokens[i]) : e]]) for i, e in zip(use, ends, strict=True)}
    trie = Trie(similarity)
    for i in right or []:
        trie.add(local[i], sizes[i], i)
    for i in left:
        has = np.zeros(len(every) + 1, bool)
        has[local[i]] = True
        trie.visit(has, np.cumsum(has), sizes[i], lambda name, i=i: groups.join(i, name))
        if right is None:
            trie.add(local[i], sizes[i], i)


def _grouped(similarity: tuple[int, int]):
    """For applyInPandas: rows (sid, n, tokens) -> edges (a, b) from each set to the first of its group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tokens = [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        groups = Groups(len(rows))
        join(tokens, rows["n"].astype(int).tolist(), list(range(len(rows))), None, groups, similarity)
        sid = rows["sid"].to_numpy(np.int64)
        root = np.array([groups.of(i) for i in range(len(rows))])
        return pd.DataFrame({"a": sid, "b": sid[root]})

    return run


LEFT, RIGHT, BOTH = range(3)


def _meetings(similarity: tuple[int, int]):
    """For mapInArrow: rows (key, side, n, tokens, label) in order of key -> edges (a, b) between labels, by links of a left with a right set of one key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(rows(batches), itemgetter(0)):
            _, side, sizes, packed, label = zip(*group, strict=True)
            left = [i for i, s in enumerate(side) if s != RIGHT]
            right = [i for i, s in enumerate(side) if s != LEFT]
            if not left or not right:
                continue
            groups, first = Groups(len(label)), {}
            for i, x in enumerate(label):  # sets of one component come linked
                groups.join(i, first.setdefault(x, i))
            join([np.frombuffer(t, np.uint64) for t in packed], list(sizes), left, right, groups, similarity)
            edges = sorted({(x, label[groups.of(i)]) for x, i in first.items() if label[groups.of(i)] != x})
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*edges, strict=True) if edges else ([], []))], ["a", "b"])

    return run


_PREFIX = "transform(sequence(0, prefix - 1), i -> xxhash64(substring(tokens, 8 * i + 1, 8)))"


def set_components(active: DataFrame, similarity: tuple[int, int] = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, label) over the classes of active, a stored table that is deleted, that have a link."""
    count = active.count()
    stars = active.select("sid", F.explode(F.expr(_PREFIX)).alias("t")).withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(salts(count))))
    # two levels of stars, so that no shingle's classes meet in one task
    inner = stars.groupBy("t", "salt").agg(F.min("sid").alias("b"))
    outer = inner.groupBy("t").agg(F.min("b").alias("top"))
    stars = stars.join(shuffled(inner), ["t", "salt"]).select(F.col("sid").alias("a"), "b").union(inner.join(shuffled(outer), "t").select(F.col("b").alias("a"), F.col("top").alias("b")))
    family = components(stars.where("a <> b").distinct())
    family = store(family)
    sized = store(family.groupBy("label").agg(F.count("*").alias("size")))
    member = active.join(joinable(family), F.col("sid") == F.col("node")).drop("node")  # if small, the sets stay where they are
    member = store(hub_join(member, sized, "label", count))
    drop(active, family, sized)
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    member = member.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    pairs = "a long, b long"
    inner = store(member.select("label", "block", "sid", "n", "tokens").groupBy("label", "block").applyInPandas(_grouped(similarity), pairs))
    big = member.where("blocks > 1")
    if big.isEmpty():
        return components(inner)
    # one set for each group of a block, all of a family together, again in blocks: most groups meet here
    heads = big.join(shuffled(inner.select(F.col("b").alias("sid")).distinct()), "sid")
    heads = store(heads)
    counts = store(heads.groupBy("label").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts")))
    heads = hub_join(heads, counts, "label", count).withColumn("part", F.pmod(F.xxhash64("sid", F.lit("head")), F.col("parts")).cast("int"))
    met = store(heads.select("label", "part", "sid", "n", "tokens").groupBy("label", "part").applyInPandas(_grouped(similarity), pairs))
    known = store(components(inner.union(met)))
    big = store(big.select("sid", "n", "tokens", "prefix", F.col("label").alias("family")).join(shuffled(known.select(F.col("node").alias("sid"), "label")), "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    drop(member, inner, heads, counts, met)
    more = _between(big, similarity, block)
    drop(big)
    return components(known.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))


def _between(big: DataFrame, similarity: tuple[int, int], block: int) -> DataFrame:
    """Stored edges (a, b) between the labels of sets that link, of big, a stored table of sets with the labels of the components known so far.

    Sets that link share a prefix shingle, so those of each such shingle meet, if they are of several components: the ones
    outside the shingle's largest component are held against all. Shingles that the same sets have are one. A family whose shingles would make more work
    than all its sets together meets as a whole instead. Where more than block sets meet, they do so in blocks by size, as sets of very different sizes have no link.
    """
    light = store(big.select("family", "sid", "label", "n", F.explode(F.expr(_PREFIX)).alias("t")).union(big.select("family", "sid", "label", "n", "family")))
    each = light.groupBy("family", "t", "label").agg(F.count("*").alias("k"), *[F.bit_xor(F.xxhash64("sid", F.lit(i))).alias(f"x{i}") for i in range(2)])
    token = each.groupBy("family", "t").agg(F.sum("k").alias("all"), F.max("k").alias("most"), F.max_by("label", F.struct("k", "label")).alias("main"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"))
    alike = F.col("family") == F.col("t")
    token = token.where("all > most").groupBy("family", "all", "x0", "x1", alike.alias("whole")).agg(F.min("t").alias("t"), F.first("main").alias("main"), F.first("most").alias("most"))
    token = store(token.drop("x0", "x1"))
    work = F.col("all").cast("double") * (F.col("all") - F.col("most"))
    dense = token.groupBy("family").agg(F.sum(F.when(~F.col("whole"), work)).alias("apart"), F.sum(F.when(F.col("whole"), work)).alias("together")).where("together <= apart")
    dense = store(dense.select("family", F.lit(True).alias("dense")))  # families whose sets share so many shingles that they meet but once, all of them
    chosen = token.join(joinable(dense), "family", "left").where(F.col("whole") == F.coalesce("dense", F.lit(False))).select("family", "t", "all", "main")
    chosen = store(chosen)
    met = store(light.join(joinable(chosen), ["family", "t"]).withColumn("outside", F.col("label") != F.col("main")))
    small = met.where(F.col("all") <= block).select(F.col("t").alias("key"), "sid", F.when(F.col("outside"), BOTH).otherwise(RIGHT).alias("side"))
    # sets whose sizes are a fifth apart at most have bands that are one apart at most
    large = met.where(F.col("all") > block).withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.02 * similarity[1] / similarity[0]))).cast("int"))
    parts = lambda n: F.ceil(n / F.lit(block)).cast("int")
    held = large.groupBy("t", "band").agg(parts(F.count("*")).alias("all"), parts(F.count_if("outside")).alias("left"))
    held = store(held.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("all", "left")))).alias("held")))  # a band for each fifth of a size
    large = large.join(joinable(held), "t").withColumn("other", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    large = large.withColumns({"own": F.expr("try_element_at(held, band)"), "its": F.expr("try_element_at(held, other)")})
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda n: F.pmod(F.xxhash64("sid"), n).cast("int")
    left = large.where("outside and its is not null").withColumns({"one": dealt(F.col("own.left")), "two": every(F.col("its.all"))})
    right = large.where("its.left > 0").withColumns({"two": dealt(F.col("own.all")), "one": every(F.col("its.left"))})
    placed = small.union(left.select(F.xxhash64("t", "band", "one", "other", "two"), "sid", F.lit(LEFT))).union(right.select(F.xxhash64("t", "other", "one", "band", "two"), "sid", F.lit(RIGHT)))
    rows = placed.join(shuffled(big), "sid").select("key", "side", "n", "tokens", "label")
    out = store(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_meetings(similarity), "a long, b long"))
    drop(light, token, dense, chosen, met, held)
    return out


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Stored digests of the documents; stored classes of equal sets (sid, least doc_id, n); the first hashes that two sets share."""
    own = store(digests(docs))
    named = own.where(F.col("sid").isNotNull())
    classes = store(named.groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.min("other").alias("one"), F.max("other").alias("two")))
    clash = classes.where("one <> two").select("sid")
    if clash.isEmpty():
        return own, classes, np.zeros(0, np.uint64)
    # among N sets some N * N / 2 ** 65 pairs, ten or so among 2e10; they go by the other hash
    if not few(clash):
        raise ValueError("too many sets agree in their first hash")
    renamed = np.sort(np.array([r.sid for r in clash.collect()], np.int64).view(np.uint64))
    drop(own, classes)
    own = store(digests(docs, renamed))
    return own, store(own.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))), renamed


def components_of(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Stored digests (doc_id, n, sid); for each class (__sid) the component_id and a label of its component; the hashes that two sets share."""
    own, classes, renamed = classes_of(docs)
    whole = classes.agg(F.count("*").alias("classes"), F.sum("n").alias("total")).first()
    if whole.classes:
        active = store(shared_sets(docs, classes, int(whole.total), whole.classes, similarity, renamed=renamed))
        free_shuffles(docs.sparkSession)
        label = set_components(active, similarity)
        named = classes.join(shuffled(label), F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("label", "sid").alias("label"))
    else:
        named = classes.select("sid", "least", F.col("sid").alias("label"))
    named = store(named)
    lowest = store(named.groupBy("label").agg(F.min("least").alias("component_id")))
    out = store(hub_join(named, lowest, "label", whole.classes).select(F.col("sid").alias("__sid"), "label", "component_id"))
    drop(classes, named, lowest)
    return own, out, renamed  # a plain side, so that a class of many copies is split


def linked(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    own, named, _ = components_of(docs, similarity)
    out = own.where(F.col("sid").isNotNull()).join(shuffled(named), F.col("sid") == F.col("__sid"), "left")
    out = out.select("doc_id", "n", "component_id").union(own.where(F.col("sid").isNull()).select("doc_id", "n", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with one row of each group of linked documents, of those with the smallest doc_id.

    If rows of that id have several sets, one set stays, and of its rows the least as JSON. Rows with a null doc_id and
    those without words all stay.
    """
    own, named, renamed = components_of(docs, similarity)
    groups = own.where(F.col("sid").isNotNull()).join(shuffled(named), F.col("sid") == F.col("__sid"), "left")
    gone, again = unused(docs, "gone", "again")
    removed = store(groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(gone)).distinct())
    twice = store(own.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again)))
    if twice.isEmpty():
        return docs.join(joinable(removed), F.col("doc_id") == F.col(gone), "left_anti")
    some = joinable(twice)  # their rows are told apart by their sets
    single = docs.join(some, F.col("doc_id") == F.col(again), "left_anti").join(joinable(removed), F.col("doc_id") == F.col(gone), "left_anti")
    several = docs.join(some, F.col("doc_id") == F.col(again), "left_semi")
    return single.unionByName(_one_each(several, groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id", "label").agg(F.min("sid").alias("sid")), renamed))


def _one_each(rows: DataFrame, firsts: DataFrame, renamed: np.ndarray) -> DataFrame:
    """One of the rows of each (doc_id, sid) of firsts, and all rows without words."""
    sid, whole, first, its = unused(rows, "sid", "whole", "first", "its")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sets(buf, offsets, renamed)[1:3] for _, _, buf, offsets in pieces(batch.column(batch.num_columns - 1))]
            n, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids.view(np.int64), mask=n == 0), batch.column(batch.num_columns - 1)], [*batch.schema.names[:-1], sid, "text"])

    moved = rows.select(*[c for c in rows.columns if c != "text"], "text")
    named = moved.mapInArrow(name, T.StructType([*moved.schema.fields[:-1], T.StructField(sid, T.LongType()), moved.schema["text"]]))
    chosen = firsts.select(F.col("doc_id").alias(first), F.col("sid").alias(its))
    linked = named.where(F.col(sid).isNotNull()).join(shuffled(chosen), (F.col("doc_id") == F.col(first)) & (F.col(sid) == F.col(its)), "left_semi")
    each = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    linked = linked.select("doc_id", sid, each.alias(whole)).groupBy("doc_id", sid).agg(F.min_by(whole, F.to_json(whole)).alias(whole))
    return linked.select(f"{whole}.*").unionByName(named.where(F.col(sid).isNull()).select(*[F.col(f"`{c}`") for c in rows.columns]))
