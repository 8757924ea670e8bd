"""Language identification by prediction by partial matching.

For each language a context tree of bytes (three bytes deep) is counted over a bounded sample of
its labelled texts and then frozen. A text's code length under a language is the sum over its
bytes of -log2 of the byte's probability in the deepest context of the tree, with escape
probabilities (method C) down to shorter contexts, and at last a uniform byte. The language of
the shortest code wins; its score is its probability if all languages are equally likely before.

Every context of the sample is kept. Languages are scored GROUP at a time: the trees of a group are
flattened into hash tables from the strings of one to four bytes that occur in it to their costs
by language, so whole batches of texts are scored by array lookups, each byte once for the group;
strings that the group never saw are charged their escapes. Texts are lower-cased and runs of
anything but letters (Unicode category L) become one space. Whole texts are scored.

Cases: a null text or one without a letter is `und` with score 0; with nothing to learn from,
every text is `und`; ties go to the language that is first in order; long texts are scored in
pieces that carry their context over; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 1500
"""Labelled texts for each language, as expected from a coin by doc_id: the bound on what is fitted."""
SAMPLE_BYTES = 128 << 20
"""Bytes of labelled texts, over all languages in equal shares, as expected from that coin: the bound with many or long ones."""
GROUP = 16
UNDETERMINED = "und"
DEPTH = 3
PIECE = 1 << 18

_ASCII = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_OTHER = re.compile("[" + "".join(chr(c) for c in range(128, 1 << 16) if not chr(c).isalpha() and not 0xD800 <= c < 0xE000) + "]")
_HIGH = re.compile("[^\x00-\uffff]")


def normal(text: str) -> str:
    """Letters (characters of a category L) in lower case, and a space for each run of others between them."""
    text = text.lower().encode().translate(_ASCII).decode()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
        if _HIGH.search(text):
            text = "".join(c if c.isalpha() else " " for c in text)
    return " ".join(text.split())


def strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The four bytes that end at each byte of the texts, as numbers, and how many each text has. Each text begins after three spaces, which are context alone."""
    padded = [b"   " + t.encode() for t in texts]
    size = np.array([len(x) for x in padded], np.int64)
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint32)
    if len(raw) <= DEPTH:
        return np.zeros(0, np.uint32), size - DEPTH
    own = np.ones(len(raw), bool)
    own[((np.cumsum(size) - size)[:, None] + np.arange(DEPTH)).ravel()] = False
    coded = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    return coded[own[3:]], size - DEPTH


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct strings of the texts, and their counts."""
    return np.unique(strings(texts)[0], return_counts=True)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(normal(text))
        for lang, texts in by.items():
            coded, n = grams(texts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(coded.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Rows:
    """The row of each key: a hash table with open addressing, for whole arrays of keys. A key that is not there has the row after the last."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([keys.astype(np.int64), [-1]])
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.slots, self.probes = np.uint32(32 - bits), np.full(1 << bits, len(keys), np.int32), 0
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = self._slots(keys[left].astype(np.uint32), self.probes)
            free = self.slots[at] == len(keys)
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            self.probes += 1

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return (((keys * np.uint32(2654435769)) >> self.shift).astype(np.int64) + probe) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        none = len(self.keys) - 1
        row = self.slots[self._slots(keys, 0)]
        other = np.flatnonzero((self.keys[row] != keys) & (row != none))
        for probe in range(1, self.probes + 1):
            if not len(other):
                break
            at = self.slots[self._slots(keys[other], probe)] if probe < self.probes else np.full(len(other), none, np.int32)
            row[other] = at
            other = other[(self.keys[at] != keys[other]) & (at != none)]
        return row


class Trees:
    """The frozen trees of a group of languages: costs of the strings seen, and of escapes from the contexts seen."""

    def __init__(self, many: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.many = many
        self.string: list[Rows] = []
        self.context: list[Rows] = []
        self.cost: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        below = np.full((1, many), 8.0)  # a byte that was never seen
        for depth in range(DEPTH + 1):
            seen, row = np.unique(gram & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            held, place = np.unique(seen >> 8, return_inverse=True)
            counts = np.bincount(row * many + lang, n, len(seen) * many).reshape(len(seen), many)
            total, distinct = np.zeros((len(held), many)), np.zeros((len(held), many))
            np.add.at(total, place, counts)
            np.add.at(distinct, place, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, np.log2(total + distinct) - np.log2(distinct), 0.0)
                own = np.log2(total + distinct)[place] - np.log2(counts)
            shorter = np.zeros(len(seen), np.int64) if depth == 0 else self.string[-1].find((seen & ((1 << 8 * depth) - 1)).astype(np.uint32))
            cost = np.where(counts > 0, own, escape[place] + below[shorter])
            self.string.append(Rows(seen))
            self.context.append(Rows(held))
            below = np.concatenate([cost, np.zeros((1, many))])
            self.cost.append(below.astype(np.float32))
            self.escape.append(np.concatenate([escape, np.zeros((1, many))]).astype(np.float32))

    def bits(self, coded: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code lengths of runs of strings that end where told: a row for each, a column for each language."""
        row = self.string[DEPTH].find(coded)
        begins = np.concatenate([[0], ends[:-1]])
        out = np.zeros((len(ends), self.many))
        for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            if b > a:
                out[i] = np.take(self.cost[DEPTH], row[a:b], 0).sum(0, dtype=np.float64)
        odd = np.flatnonzero(row == len(self.cost[DEPTH]) - 1)
        if len(odd):  # never seen in full: the escape, and the cost after the shorter context
            text = np.searchsorted(ends, odd, "right")
            np.add.at(out, text, self._unseen(coded[odd], DEPTH))
        return out

    def _unseen(self, coded: np.ndarray, depth: int) -> np.ndarray:
        cost = self.escape[depth][self.context[depth].find(coded >> np.uint32(8))].astype(np.float64)
        if depth == 0:
            return cost + 8.0
        coded = coded & np.uint32((1 << 8 * depth) - 1)
        row = self.string[depth - 1].find(coded)
        cost += self.cost[depth - 1][row]
        odd = np.flatnonzero(row == len(self.cost[depth - 1]) - 1)
        if len(odd):
            cost[odd] += self._unseen(coded[odd], depth - 1)
        return cost


class Model:
    """Frozen statistics of all languages."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, group: int = GROUP):
        self.langs, self.trees = langs, []
        for lo in range(0, len(langs), group):
            own = (lang >= lo) & (lang < lo + group)
            self.trees.append(Trees(min(group, len(langs) - lo), lang[own] - lo, gram[own], n[own]))

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths of normal texts: a row for each, a column for each language."""
        out = np.zeros((len(texts), len(self.langs)))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < 4 * PIECE:
                size += len(texts[hi])
                hi += 1
            coded, n = strings(texts[lo:hi])
            ends = np.cumsum(n)
            begins = ends - n
            # long texts in pieces, each string with its context
            cut = [(i, a, min(a + PIECE, int(e))) for i, (b, e) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)) for a in range(b, e, PIECE)]
            if cut:
                owner, stop = np.array([c[0] for c in cut]), np.array([c[2] for c in cut])
                for k, trees in enumerate(self.trees):
                    np.add.at(out, (lo + owner[:, None], k * len(self.trees[0].cost[0][0]) + np.arange(trees.many)), trees.bits(coded, stop))
            lo = hi
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clean = [normal(t) if t else "" for t in texts]
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        known = [i for i, t in enumerate(clean) if t]
        bits = self.bits([clean[i] for i in known])
        best = bits.argmin(1)
        odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0)).sum(1)
        for i, b, o in zip(known, best, odds, strict=True):
            names[i], scores[i] = self.langs[b], 1.0 / float(o)
        return names, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from text and non-null lang of the documents that are not held out."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r.lang: (r.n, r.size) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("size")).collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return Model([], *[np.zeros(0, np.int64)] * 3)
    shares = [min(1.0, sample_docs / n, sample_bytes / len(langs) / max(size, 1)) for n, size in (counts[x] for x in langs)]
    least = F.create_map(*[F.lit(x) for lang, share in zip(langs, shares, strict=True) for x in (lang, math.ceil((1 << 20) * share))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("ppm")), F.lit(1 << 20)) < F.element_at(least, F.col("lang")))
    counted = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    found = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    place = {lang: i for i, lang in enumerate(langs)}
    return Model(langs, np.array([place[x] for x in found["lang"].to_pylist()], np.int64), found["gram"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.float64))


def predict(docs: DataFrame, model: Model, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """id_columns with lang_pred and score for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*id_columns, "text")
    ids = kept.drop("text").schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                names, scores = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(score, ids.add("lang_pred", "string").add("score", "double"))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """For each document: doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs, sample_docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, least: float = 0.5) -> DataFrame:
    """docs without those whose language is undetermined or has a score below least."""
    names = [c for c in docs.columns if c != "text"]
    model = fit(docs, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    order = [*names, "text"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                langs, scores = shared.value.predict(batch.column(batch.num_columns - 1).to_pylist())
                yield batch.filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    moved = docs.select(*order)
    return moved.mapInArrow(keep, moved.schema).select(*docs.columns)
