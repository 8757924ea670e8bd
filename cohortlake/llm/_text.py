"""Words and shingles of whole batches of texts with numpy, straight from Arrow's buffers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

SHINGLE = 5
PIECE_BYTES = 1_000_000
"""So many bytes of text are worked on at once; only a single longer text makes a larger piece, whose words are hashed in slices."""

_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = max(n, PIECE_BYTES + 4096)
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[key] = np.multiply.accumulate(x)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(text: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of rows; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    n, (_, offsets, data) = len(text), text.buffers()
    if not n:
        return
    at = np.frombuffer(offsets, dtype=kind)[text.offset : text.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(at)
    if text.null_count:
        size = np.where(np.asarray(text.is_valid()), size, 0)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        if size[lo:hi].sum() == at[hi] - at[lo]:
            yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        else:
            ends = np.concatenate([[0], np.cumsum(size[lo:hi])])
            yield lo, hi, np.concatenate([raw[at[i] : at[i] + size[i]] for i in range(lo, hi)]), ends
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased (A-Z) texts, the text that each belongs to, words in each text."""
    if len(offsets) == 2 and len(buf) > 2 * PIECE_BYTES:
        hashed = np.concatenate([_words(buf[a:b], np.array([0, b - a]))[0] for a, b in pairwise(_cut_at_gaps(buf))])
        return hashed, np.zeros(len(hashed), np.int64), np.array([len(hashed)])
    return _words(buf, offsets)


def _cut_at_gaps(buf: np.ndarray) -> list[int]:
    """Places that cut a long text into slices of about PIECE_BYTES, each before a separator."""
    out = [0]
    while len(buf) - out[-1] > 2 * PIECE_BYTES:
        at = out[-1] + PIECE_BYTES
        while at < len(buf):
            gap = np.flatnonzero(_SEPARATOR[buf[at : at + PIECE_BYTES]])
            if len(gap):
                at += int(gap[0])
                break
            at += PIECE_BYTES
        out.append(min(at, len(buf)))
    return out if out[-1] == len(buf) else [*out, len(buf)]


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[buf]
    inside = ~_SEPARATOR[low]
    size = np.diff(offsets)
    full = offsets[:-1][size > 0]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[full] = inside[full]
    last[(offsets[1:] - 1)[size > 0]] = inside[(offsets[1:] - 1)[size > 0]]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    upto = np.searchsorted(start, offsets)
    count = np.diff(upto)
    return hashed, np.repeat(np.arange(len(count)), count), count


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order of place, and the text of each; a text of fewer words has one, of all its words."""
    hashed, owner, count = words(buf, offsets)
    at = np.concatenate([[0], np.cumsum(count)])
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), n)
    start = at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    padded = np.concatenate([hashed, np.zeros(k, np.uint64)])
    out = np.zeros(len(text), np.uint64)
    power, _ = powers(k + 1)
    for lo in range(0, len(text), PIECE_BYTES):
        at, own = start[lo : lo + PIECE_BYTES], count[text[lo : lo + PIECE_BYTES]]
        short = own < k
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            part = padded[at + j] * power[j + 1]
            if short.any():
                part = np.where(short & (j >= own), np.uint64(0), part)
            total += part
        if short.any():
            total = np.where(short, total + own.astype(np.uint64), total)
        out[lo : lo + PIECE_BYTES] = mix(total + np.uint64(k))
    return out, text


_GAP = re.compile("[ \t-\r]")
_CAPITALS = {c: c + 32 for c in range(65, 91)}


def word_runs(text: str | None, k: int = SHINGLE, limit: int = PIECE_BYTES) -> Iterator[list[str]]:
    """The words of a text, A-Z in lower case, in runs that overlap by k - 1 words, so that a long text is never held as words."""
    text, at, before = text or "", 0, []
    while at < len(text):
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        low = text[at:end]
        low = low.lower() if low.isascii() else low.translate(_CAPITALS)
        run = before + [w for w in _GAP.sub(" ", low).split(" ") if w]
        yield run
        before, at = run[-(k - 1) :], end


def plain_shingles(text: str | None, k: int = SHINGLE, wanted: set[tuple[str, ...]] | None = None) -> set[tuple[str, ...]]:
    """The same shingles as tuples of words, for exact checks; with wanted, only those among them."""
    out: set[tuple[str, ...]] = set()
    words: list[str] | None = []
    for run in word_runs(text, k):
        found = zip(*[run[i:] for i in range(k)], strict=False)
        out.update(found if wanted is None else wanted.intersection(found))
        words = run if words is not None and len(run) < k else None
    if words:  # never so many as k
        out = {tuple(words)} if wanted is None else wanted & {tuple(words)}
    return out
