"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if it is covered by a string of DEPTH bytes that also starts in a document of a
smaller id. Suffixes are ordered only through their first DEPTH bytes, by passes from the most
significant digit on; suffixes that are equal after the last pass are exactly the repeated
windows, and groups that hold one document alone are dropped after every pass.

The first digit is not the first bytes but the window's minimizer: of the SEED-byte strings in
the window, the one of least hash, the leftmost of equals. Equal windows have equal minimizers in
the same place, so the digit splits no group, and neighbouring windows mostly share one: one
entry for some sixteen suffixes is dealt out, in packed form. Minimizers that a single text has
end there. Runs of windows with a shared one are dealt out with their bytes. Each bucket sorts whole runs
first, by place and digits of eight bytes, so that equal ones are cut into windows once, and then
the windows that are left.

Equal texts are one class, by two hashes of 64 bits: all but that of the smallest id are removed
whole. What repeats in a piece of a few megabytes is settled there, and only that of the smallest
id is dealt on, so a frequent line sends one entry a piece. Runs of a minimizer that a sample shows
to be frequent are dealt out as single windows, by a hash of the window, so that no bucket holds
all that surrounds a frequent line; with very many pieces, such windows are merged in two levels.

Cases: a null text is empty; texts of fewer than DEPTH bytes keep all; a row with a null id is
neither removed from nor a reason to remove; rows of one id are no reason for each other, and
repeated rows have equal results, while rows of one id with different texts are judged each for
itself; texts of any length are worked on in slices; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop, free_shuffles, store
from ._text import PIECE_BYTES, mix, pieces, powers

DEPTH = 50
SEED = 20
BYTES = 5
"""Bytes of a minimizer's hash that are dealt out; with the number of its bucket they tell it apart."""
BUCKET = 6_000_000
"""Entries in a bucket of minimizers, about."""
BUCKET_RUNS = 25_000
"""Runs in a bucket of windows, about: some sixteen windows each."""
CLASS_BITS = 24
SAMPLE = 64
"""One text in so many, by hash, is looked at for frequent minimizers."""
HOT_RUNS = 2000
"""A minimizer of more runs than this is frequent."""
HOT_MOST = 1_000_000
"""With more runs than HOT_RUNS times this, the limit rises, so that so many minimizers are frequent at most (8 bytes each are broadcast)."""
MERGED = 20_000
"""With more pieces than this, frequent windows are merged in salted groups of about so many pieces first."""


NUMBERS = ("bucket", "salt", "sid", "doc", "g")


def slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the slice in it, bytes, offsets): runs of rows, or slices of a long one that overlap by DEPTH - 1 bytes."""
    for lo, _, buf, offsets in pieces(text):
        if len(offsets) == 2 and len(buf) > 2 * PIECE_BYTES:
            for at in range(0, len(buf) - DEPTH + 1, PIECE_BYTES):
                part = buf[at : at + PIECE_BYTES + DEPTH - 1]
                yield lo, at, part, np.array([0, len(part)])
        else:
            yield lo, 0, buf, offsets


def hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of width bytes."""
    power, inverse = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[: len(buf) - width + 1])


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text, first window, last window, minimizer's place, its hash."""
    n = len(buf) - DEPTH + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    hashed = hashes(buf, SEED)
    low = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    width, span = 1, DEPTH - SEED + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    windows = np.maximum(size - DEPTH + 1, 0)
    text = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(offsets[:-1], windows)
    place = place[start]
    if not len(text):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    first = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (text[1:] != text[:-1])) + 1])
    last = np.concatenate([first[1:], [len(text)]]) - 1
    return text[first], start[first], start[last], place[first], hashed[place[first]]


def _cuts(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in NUMBERS else pa.binary()) for n, c in zip(names, columns, strict=True)], names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'long' if n in NUMBERS else 'binary'}" for n in names)


def _keyed(key: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """Packed arrays for each key."""
    order = np.argsort(key, kind="stable")
    key, arrays = key[order], [a[order] for a in arrays]
    cut = _cuts(key)
    return [(int(key[a]), *[x[a:b].tobytes() for x in arrays]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _low(h: np.ndarray) -> bytes:
    """The low BYTES bytes of each number."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]).tobytes()


def _high(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").ravel()


def _told(h: np.ndarray, buckets: int) -> np.ndarray:
    """A minimizer's hash as it can be told from its bucket and the bytes that are dealt out."""
    return ((h // np.uint64(buckets)) & np.uint64((1 << 8 * BYTES) - 1)) * np.uint64(buckets) + h % np.uint64(buckets)


def _owned(key: np.ndarray, owner: np.ndarray, *arrays: np.ndarray) -> list[tuple[int, np.ndarray, bytes, slice]]:
    """For each key: key, owners, packed, how many entries each has, and the place of its entries in the arrays, which are reordered."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    for x in arrays:
        x[:] = x[order]
    cut = _cuts(key)
    out = []
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = _cuts(owner[lo:hi])
        count = np.diff(own)
        out.append((int(key[lo]), owner[lo:hi][own[:-1]], count.astype(np.uint16 if count.max() < 1 << 16 else np.uint32).tobytes(), slice(lo, hi)))
    return out


def _owners(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for ids, count in zip(table.column(name).to_pylist(), table.column("count").to_pylist(), strict=True):
        ids = np.frombuffer(ids, np.int64)
        out.append(np.repeat(ids, np.frombuffer(count, np.uint16 if len(count) == 2 * len(ids) else np.uint32)))
    return np.concatenate(out)


_DEALT = ["bucket", "salt", "h", "ids", "count"]


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Minimizers by bucket, in packed form, and the classes that have them. In bucket -1 - theirs, by a salt for each piece: those already seen to be shared."""
    for batch in batches:
        ids = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, buf, offsets in slices(batch.column(0)):
            text, _, _, _, h = runs(buf, offsets)
            sid, h = ids[lo + text], _told(h, buckets)
            order = np.lexsort((sid, h))
            h, sid = h[order], sid[order]
            keep = np.concatenate([[True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])]) if len(h) else np.zeros(0, bool)
            h, sid = h[keep], sid[keep]
            size = np.diff(_cuts(h))
            many, first = np.repeat(size > 1, size), np.zeros(len(h), bool)
            first[_cuts(h)[:-1]] = True
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            rows = []
            for chosen, key in ((first, bucket), (many, -1 - bucket)):
                part = h[chosen] // np.uint64(buckets)
                salt = int(h[0] % np.uint64(1 << 30)) if len(h) and key is not bucket else 0
                rows += [(k, salt, _low(part[at]), own.tobytes(), count) for k, own, count, at in _owned(key[chosen], sid[chosen], part)]
            yield _batch(rows, _DEALT)


def _by_class(bucket: int, low: np.ndarray, sid: np.ndarray, buckets: int) -> pa.RecordBatch:
    return _batch(_keyed(sid, low * np.uint64(buckets) + np.uint64(bucket)), ["sid", "h"])


def _several(h: np.ndarray, number: np.ndarray, bits: int = CLASS_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (40 bits of a minimizer, number of a class), those whose minimizer has several classes."""
    if int(number.max(initial=0)) >> bits:
        order = np.lexsort((number, h))
        h, number = h[order], number[order]
    else:  # the two make one number, which is sorted in place
        key = h << np.uint64(bits)
        key |= number.astype(np.uint64)
        key.sort()
        h, number = key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    cut = _cuts(h)
    several = np.repeat(number[cut[:-1]] != number[cut[1:] - 1], np.diff(cut))
    return h[several], number[several]


def hot_minimizers(docs: DataFrame, total: float, sample: int = SAMPLE, least: int = HOT_RUNS) -> np.ndarray:
    """Minimizers of many runs, as a sample of the texts shows, in order of hash; total runs are expected in all."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0)):
                h, n = np.unique(runs(buf, offsets)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    limit = max(least, total / HOT_MOST) / sample
    chosen = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit("hot")), F.lit(sample)) == 0)
    found = chosen.mapInArrow(pick, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return np.sort(found.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def shared_minimizers(docs: DataFrame, buckets: int) -> DataFrame:
    """(sid, h): the minimizers, packed, that a class shares with another; several rows for a class."""

    def meet(table):
        bucket, owners = table.column("bucket")[0].as_py(), table.column("ids").to_pylist()
        h = np.concatenate([_high(x) for x in table.column("h").to_pylist()])
        if bucket < 0:
            return pa.Table.from_batches([_by_class(-1 - bucket, h, _owners(table, "ids"), buckets)])
        known, number = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in owners]), return_inverse=True)
        count = [np.frombuffer(c, np.uint16 if len(c) * 4 == len(x) else np.uint32) for x, c in zip(owners, table.column("count").to_pylist(), strict=True)]
        h, number = _several(h, np.repeat(number, np.concatenate(count)))
        return pa.Table.from_batches([_by_class(bucket, h, known[number], buckets)])

    dealt = docs.select("text", "sid").mapInArrow(lambda it: _deal(it, buckets), _schema(_DEALT))
    return dealt.groupBy("bucket", "salt").applyInArrow(meet, "sid long, h binary")


_RUN = ["bucket", "salt", "ids", "sids", "count", "first", "place", "length", "data"]
_FOUND = ["g", *_RUN]
"""What a bucket gives: spans in data, by group of documents g; or, with g = -1, windows that are dealt on."""


def union(sid: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The maximal runs of bytes that spans of documents (sid, doc) cover, in order of document and place."""
    order = np.lexsort((start, doc, sid))
    sid, doc, start, end = sid[order], doc[order], start[order], end[order]
    if not len(doc):
        return sid, doc, start, end
    turn = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (sid[1:] != sid[:-1])])) << 40  # documents one after the other
    reach = np.maximum.accumulate(end + turn)
    new = np.concatenate([[True], (start + turn)[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(doc)]]) - 1
    return sid[new], doc[new], start[new], (reach - turn)[last]


def _documents(sid: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the documents that entries, in order of them, belong to."""
    return np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (sid[1:] != sid[:-1])])) if len(doc) else np.zeros(0, np.int64)


def _spans(sid: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, groups: int) -> list[tuple]:
    """Spans, packed by group of documents: their documents, how many spans each has, (first byte, end)."""
    sid, doc, start, end = union(sid, doc, start, end)
    if not len(doc):
        return []
    pair, number = np.stack([start, end], 1).astype(np.int64), _documents(sid, doc)
    first = _cuts(number)[:-1]
    group = (sid.view(np.uint64) % np.uint64(groups)).astype(np.int64)
    return [(g, 0, 0, doc[first][own].tobytes(), sid[first][own].tobytes(), count, b"", b"", b"", pair[at].tobytes()) for g, own, count, at in _owned(group, number, pair)]


def _entries(key: np.ndarray, salt: int, row: np.ndarray, doc: np.ndarray, sid: np.ndarray, start: np.ndarray, place: np.ndarray, length: np.ndarray, strings: list[bytes] | None) -> list[tuple]:
    """Runs of the rows, packed by key."""
    at = np.arange(len(key))
    out = []
    for k, own, count, part in _owned(key, row, at):
        i = at[part]
        first = i[np.concatenate([[0], np.cumsum(np.frombuffer(count, np.uint16 if len(count) == 2 * len(own) else np.uint32).astype(np.int64))[:-1]])]
        kind = np.uint32 if start[i].max() < 1 << 32 else np.int64
        data = b"".join(strings[x] for x in i.tolist()) if strings is not None else b""
        out.append((k, salt, doc[first].tobytes(), sid[first].tobytes(), count, start[i].astype(kind).tobytes(), place[i].astype(np.uint8).tobytes(), length[i].astype(np.uint8).tobytes(), data))
    return out


def _deal_runs(batches: Iterator[pa.RecordBatch], buckets: int, told: int, hot: np.ndarray, merged: int) -> Iterator[pa.RecordBatch]:
    """Runs of shared minimizers with their bytes, by bucket, and the windows of frequent ones by a hash of their own.

    Frequent windows have a salt from 1 to merged if that is above 1. In buckets below 0, one for each piece, are
    runs already seen to go, without bytes.
    """
    codec = pa.Codec("zstd")
    for batch in batches:
        ids, sids, sizes, shared = *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)), batch.column(4)
        for at in range(0, batch.num_rows, 1000):
            texts = pa.array([codec.decompress(x, n, asbytes=True) for x, n in zip(batch.column(0).slice(at, 1000).to_pylist(), sizes[at : at + 1000].tolist(), strict=True)], pa.large_binary())
            for lo, shift, buf, offsets in slices(texts):
                lo += at
                text, first, last, place, h = runs(buf, offsets)
                known = _told(h, told)
                keep = np.zeros(len(h), bool)
                cut = _cuts(text)
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    own = np.sort(np.frombuffer(b"".join(shared[lo + int(text[a])].as_py()), np.uint64))
                    i = np.minimum(np.searchsorted(own, known[a:b]), len(own) - 1)
                    keep[a:b] = own[i] == known[a:b]
                text, first, last, place, h = text[keep], first[keep], last[keep], place[keep], h[keep]
                often = np.zeros(len(h), bool)
                if len(hot) and len(h):
                    often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                    n = (last - first + 1)[often]
                    run = np.repeat(np.flatnonzero(often), n)
                    window = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                    own = hashes(buf, DEPTH)[window] if len(window) else np.zeros(0, np.uint64)
                    text, first, last, place, h = (np.concatenate([x[~often], y]) for x, y in ((text, text[run]), (first, window), (last, window), (place, place[run]), (h, own)))
                    often = np.arange(len(h)) >= len(h) - len(window)
                row, length = lo + text, last - first + DEPTH
                doc, sid = ids[row], sids[row]
                strings = [buf[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                keys = list(zip(strings, (place - first).tolist(), strict=True))
                # equal runs of a piece: all but the smallest document's go, and one is dealt on
                least: dict[tuple[bytes, int], int] = {}
                for i, key in enumerate(keys):
                    j = least.setdefault(key, i)
                    if doc[i] < doc[j]:
                        least[key] = i
                mine = np.array([least[key] for key in keys], np.int64)
                start = first + shift - offsets[:-1][text]
                gone = doc[mine] < doc if len(doc) else np.zeros(0, bool)
                # a document that has one run twice deals on both
                rows = []
                seed = int(h[0] % np.uint64(1 << 30)) if len(h) else 0
                bucket = ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
                for some, key, salt in ((gone, np.full(len(h), -1 - seed % buckets), 0), (~gone & ~often, bucket, 0), (~gone & often, bucket, 1 + seed % merged if merged > 1 else 0)):
                    i = np.flatnonzero(some)
                    rows += _entries(key[i], salt, row[i], doc[i], sid[i], start[i], (place - first)[i], length[i], None if key is not bucket else [strings[x] for x in i.tolist()])
                yield _batch(rows, _RUN)


def _passes(data: np.ndarray, at: np.ndarray, digit: np.ndarray, length: np.ndarray, several) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorts the strings of data at the given places and of the given lengths by a first digit and then eight bytes at a time.

    Yields after the last pass the strings that are still alive and their groups of equals; after
    every pass only groups that several() finds worth it stay alive.
    """
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(96, np.uint8)]), 8)
    live, group = np.arange(len(at)), np.zeros(len(at), np.int64)
    for step in range(-1, -(-int(length.max(initial=0)) // 8)):
        if not len(live):
            return
        if step < 0:
            key = digit
        else:
            width = np.clip(length[live] - 8 * step, 0, 8)
            key = np.ascontiguousarray(view[at[live] + 8 * step]).view(">u8").ravel().astype(np.uint64)
            key = np.where(width == 0, np.uint64(0), key >> (8 * np.minimum(8 - width, 7)).astype(np.uint64))
        order = np.lexsort((key, group))
        live, key, group = live[order], key[order], group[order]
        new = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (group[1:] != group[:-1])) + 1])
        count = np.diff(np.concatenate([new, [len(live)]]))
        keep = np.repeat(several(live, new, count), count)
        group = np.repeat(np.arange(len(new)), count)[keep]
        live = live[keep]
    if len(live):
        yield live, group


def equals(data: np.ndarray, at: np.ndarray, digit: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each string, the first of its equals in the smallest document that has it. digit tells strings of different length apart."""
    out = np.arange(len(at))
    for live, group in _passes(data, at, digit, length, lambda live, new, count: count > 1):
        order = np.lexsort((live, doc[live], group))
        live, group = live[order], group[order]
        cut = _cuts(group)
        out[live] = np.repeat(live[cut[:-1]], np.diff(cut))
    return out


def repeated(data: np.ndarray, at: np.ndarray, digit: np.ndarray, doc: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which of the windows also start in a smaller document. Groups of one document are dropped after every pass."""

    def several(live, new, count):
        owner = doc[live]
        return np.minimum.reduceat(owner, new) < np.maximum.reduceat(owner, new)

    out = np.zeros(len(at), bool)
    for live, group in _passes(data, at, digit, np.full(len(at), depth), several):
        cut = _cuts(group)
        out[live] = doc[live] > np.repeat(np.minimum.reduceat(doc[live], cut[:-1]), np.diff(cut))
    return out


def _meet(table: pa.Table, groups: int) -> pa.Table:
    """The runs of a bucket: spans of what is in a smaller document, too; of a salted one, also the windows that are dealt on."""
    bucket, salt = (table.column(c)[0].as_py() for c in ("bucket", "salt"))
    doc, sid = _owners(table, "ids"), _owners(table, "sids")
    first = np.concatenate([np.frombuffer(f, np.uint32 if len(f) == 4 * len(p) else np.int64).astype(np.int64) for f, p in zip(table.column("first").to_pylist(), table.column("place").to_pylist(), strict=True)])
    place, length, data = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8) for c in ("place", "length", "data"))
    place, length = place.astype(np.int64), length.astype(np.int64)
    if bucket < 0:
        return pa.Table.from_batches([_batch(_spans(sid, doc, first, first + length, groups), _FOUND)])
    begin = np.cumsum(length) - length
    # whole runs first: of equal ones, those of larger documents go, and only one is cut into windows
    head = equals(data, begin, (place * 256 + length).astype(np.uint64), length, doc)
    whole = doc > doc[head]
    if salt > 0:
        out = _spans(sid[whole], doc[whole], first[whole], (first + length)[whole], groups)
        rest = np.flatnonzero(~whole)
        strings = [data[a : a + DEPTH].tobytes() for a in begin[rest].tolist()]
        row = np.unique(np.stack([sid[rest], doc[rest]]), axis=1, return_inverse=True)[1].ravel() if len(rest) else rest
        out += [(-1, *x) for x in _entries(np.full(len(rest), bucket), 0, row, doc[rest], sid[rest], first[rest], place[rest], length[rest], strings)]
        return pa.Table.from_batches([_batch(out, _FOUND)])
    some = np.flatnonzero(head == np.arange(len(head)))
    windows = length[some] - DEPTH + 1
    offset = np.zeros(len(head), np.int64)
    offset[some] = np.cumsum(windows) - windows
    entry = np.repeat(some, windows)
    shift = np.arange(len(entry)) - np.repeat(offset[some], windows)
    gone = repeated(data, begin[entry] + shift, (place[entry] - shift + DEPTH).astype(np.uint64), doc[entry])
    # the windows of a run tell of its equals in the same document, too
    rest = np.flatnonzero(~whole)
    windows = length[rest] - DEPTH + 1
    entry = np.repeat(rest, windows)
    shift = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    found = gone[offset[head[entry]] + shift]
    start, entry = (first[entry] + shift)[found], entry[found]
    spans = _spans(np.concatenate([sid[whole], sid[entry]]), np.concatenate([doc[whole], doc[entry]]), np.concatenate([first[whole], start]), np.concatenate([(first + length)[whole], start + DEPTH]), groups)
    return pa.Table.from_batches([_batch(spans, _FOUND)])


def removed_spans(rows: DataFrame, buckets: int, told: int, hot: np.ndarray, merged: int = 1) -> DataFrame:
    """(packed text, doc_id, sid, shared minimizers) -> (doc, sid, spans): what to remove of each document that something is removed of."""
    groups = max(1, buckets // 4)

    def gather(table):
        doc, sid = _owners(table, "ids"), _owners(table, "sids")
        pair = np.frombuffer(b"".join(table.column("data").to_pylist()), np.int64).reshape(-1, 2)
        sid, doc, start, end = union(sid, doc, pair[:, 0], pair[:, 1])
        pair, cut = np.stack([start, end], 1), _cuts(_documents(sid, doc))
        return pa.Table.from_batches([_batch([(int(doc[a]), int(sid[a]), pair[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], ["doc", "sid", "spans"])])

    shared = rows.sparkSession.sparkContext.broadcast(hot)
    dealt = rows.select("packed", "doc_id", "sid", "n_bytes", "shared").mapInArrow(lambda it: _deal_runs(it, buckets, told, shared.value, merged), _schema(_RUN))
    found = dealt.groupBy("bucket", "salt").applyInArrow(lambda table: _meet(table, groups), _schema(_FOUND))
    if merged > 1:
        found = store(found)
        again = found.where("g < 0").select(*_RUN).groupBy("bucket", "salt").applyInArrow(lambda table: _meet(table, groups), _schema(_FOUND))
        found = found.where("g >= 0").unionByName(again)
    return found.select("g", "ids", "sids", "count", "data").groupBy("g").applyInArrow(gather, "doc long, sid long, spans binary")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, sid, other, n_bytes, sha (of the text), packed (the text, compressed, as it is shuffled by id)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            raw = [x.as_buffer() for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x.size for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())],
                ["doc_id", "sid", "other", "n_bytes", "sha", "packed"],
            )

    return docs.select("doc_id", "sid", "other", "text").mapInArrow(pack, "doc_id long, sid long, other long, n_bytes long, sha string, packed binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        out = []
        for doc, n, text, spans in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            raw = codec.decompress(text, n, asbytes=True)
            found = np.frombuffer(spans, np.int64).reshape(-1, 2)
            parts, at = [], 0
            for a, b in found.tolist():
                parts.append(raw[at:a])
                at = b
            kept = b"".join(parts) + raw[at:]
            out.append((doc, n, n - len(kept), len(found), hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal(docs: DataFrame, bucket: int = BUCKET, bucket_runs: int = BUCKET_RUNS, merged: int = MERGED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sid"), F.xxhash64(F.lit("other"), text).alias("other"))
    named = base.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= DEPTH))
    classes = store(named.groupBy("sid", "other").agg(F.min("doc_id").alias("least"), F.max(F.octet_length("text")).alias("n")))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    expected = total / ((DEPTH - SEED + 2) / 2)
    hot = hot_minimizers(named, expected)
    told = max(1, math.ceil(expected / bucket))
    found = store(shared_minimizers(named, told))
    entries = found.agg(F.coalesce(F.sum(F.octet_length("h") / 8), F.lit(0.0)).alias("n")).first().n
    free_shuffles(spark)
    shared = found.groupBy("sid").agg(F.collect_list("h").alias("shared")).join(classes.select("sid", "other", F.col("least").alias("doc_id")), "sid")
    first = packed(named).join(shared, ["sid", "other", "doc_id"])
    spans = store(removed_spans(first, max(1, math.ceil(entries / bucket_runs)), told, hot, math.ceil(total / PIECE_BYTES / merged)))
    free_shuffles(spark)
    drop(found)
    # of a class, the rows of the least id are cut, and all others are copies; another text of that id has its own class
    ours = spans.select("doc", F.col("sid").alias("__sid"), "spans")
    touched = packed(base).join(ours, (F.col("doc_id") == F.col("doc")) & (F.col("sid") == F.col("__sid")), "left")
    cut = touched.where(F.col("spans").isNotNull()).select("doc_id", "n_bytes", "packed", "spans").mapInArrow(_cut, RESULT)
    copy = classes.select(F.col("sid").alias("__c"), F.col("other").alias("__o"), "least")
    plain = touched.where(F.col("spans").isNull()).select("doc_id", "sid", "other", "n_bytes", "sha")
    plain = plain.join(copy, (F.col("sid") == F.col("__c")) & (F.col("other") == F.col("__o")) & (F.col("n_bytes") >= DEPTH) & (F.col("doc_id") > F.col("least")), "left")
    is_copy = F.col("least").isNotNull()
    plain = plain.select(
        "doc_id", "n_bytes", F.when(is_copy, F.col("n_bytes")).otherwise(0).cast("long").alias("n_removed"), is_copy.cast("long").alias("n_spans"), F.when(is_copy, F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256")
    )
    return cut.unionByName(plain)
