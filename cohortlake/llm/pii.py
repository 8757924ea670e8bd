"""Personal data by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stand. Further spans of
the kinds in KINDS are proposed by wide patterns, and labelers vote on each: patterns, gazetteers
of cue words, and context. A labeler says yes (1), no (-1) or nothing (0). The votes of all
proposals in the corpus are counted by pattern of votes, of which there are few;
expectation-maximisation over those counts estimates how reliable each labeler is and how likely
each pattern is to be personal data. A logistic regression on votes and shape, weighted by those
probabilities, is the final classifier: a proposal is a span if it has a probability of a half
or more.

Offsets are code points, ends exclusive. Cases: a null text is empty and has no spans; matches
of a base pattern that fail its test are dropped without another try; spans of the method that
overlap a base span or an earlier one are dropped; without proposals, nothing is fitted; long
texts are scanned in time that is linear in their length; extra columns are kept or not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = ("localphone", "secret")
ROUNDS = 100
PRIOR_SHARE = 0.02
"""Strength of the belief that labelers are right, as a share of the proposals."""
Span = tuple[int, int]

_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, digits = m.start(), m.group().split(".")
        for i in range(0, len(digits) - 3, 4):
            four = digits[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in four if x.strip("0")):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in ips(text)]
        out += [("card", *s) for s in cards(text)]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


# Cue words of credentials and of telephone numbers, and marks of issued keys.
CREDENTIAL_CUES = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential")
PHONE_CUES = ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp")
KEY_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk_test_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")

_TOKEN = re.compile(r"[^\s\"'`<>,;:=(){}\[\]]{12,}+")
_LOCALPHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]?[0-9])")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_CAPITAL = re.compile(r"(?=.*[A-Z].*[A-Z])(?=.*[0-9].*[0-9])[A-Z0-9]{16,}")
_PATHLIKE = re.compile(r".*(://|www\.|[/\\].*[/\\]|\.(html?|php|png|jpe?g|com|org|net)\b)")
_WORD = re.compile(r"[a-z_]+")
_PIECE = re.compile(r"[A-Za-z]+|[0-9]+")


def _cue(text: str, start: int, cues: tuple[str, ...]) -> bool:
    return any(w.strip("_") in cues for w in _WORD.findall(text[max(0, start - 24) : start].lower())[-2:])


def proposals(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes and shape) of what may be personal data beside the base spans."""
    out = []
    if not _DIGIT.search(text):
        return out
    spans = sorted((s, e) for _, s, e in taken)
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return not before or reach[before - 1] <= start

    for m in _LOCALPHONE.finditer(text):
        if free(*m.span()):
            word = m.group()
            votes = (1 if word[0] == "(" else 0, 1 if _cue(text, m.start(), PHONE_CUES) else 0, 1 if len({c for c in word if not c.isdigit()}) <= 2 else -1, 1 if text[m.end() : m.end() + 1] in ("", " ", ".", ",", "\n") else -1, 1 if word.lstrip("(")[0] not in "01" else -1)
            out.append(("localphone", *m.span(), (*votes, 0)))
    for m in _TOKEN.finditer(text):
        word = m.group()
        if not _DIGIT.search(word) or not any("a" <= c <= "z" or "A" <= c <= "Z" for c in word) or not free(*m.span()):
            continue
        marked = any(word.startswith(x) for x in KEY_MARKS)
        kinds = (any(c.islower() for c in word), any(c.isupper() for c in word), any(c.isdigit() for c in word))
        votes = (
            1 if marked else 0,
            1 if _HEX.fullmatch(word) or _CAPITAL.fullmatch(word) or (all(kinds) and len(word) >= 20) else -1,
            1 if _cue(text, m.start(), CREDENTIAL_CUES) else 0,
            1 if text[max(0, m.start() - 2) : m.start()].strip(" \"'")[-1:] in ("=", ":") or text[m.start() - 1 : m.start()] in ('"', "'") else 0,
            -1 if _PATHLIKE.match(word) or not word.isascii() or len(word) > 5 * len(_PIECE.findall(word)) else 1 if len(set(word)) >= 10 else -1,  # words and numbers come in few pieces
        )
        out.append(("secret", *m.span(), (*votes, min(3, len(word) // 8))))
    return out


class Labeling:
    """Reliabilities of the labelers of each kind by expectation-maximisation, and the classifier trained on its labels."""

    def __init__(self, counts: dict[tuple[str, tuple[int, ...]], int]):
        self.weights: dict[str, np.ndarray] = {}
        self.reliability: dict[str, np.ndarray] = {}
        self.prior: dict[str, float] = {}
        for kind in KINDS:
            rows = sorted((k[1], n) for k, n in counts.items() if k[0] == kind)
            if rows:
                shape, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
                self._fit(kind, shape, n)

    def _fit(self, kind: str, shape: np.ndarray, n: np.ndarray) -> None:
        votes = shape[:, :-1]
        yes, no = votes == 1, votes == -1  # a labeler that says nothing is no evidence
        weak = max(1.0, PRIOR_SHARE * n.sum())  # labelers are held to be mostly right until counts tell otherwise
        p = 1 / (1 + np.exp(-votes.sum(1)))  # at first, the majority
        for _ in range(ROUNDS):
            w1, w0 = (p * n)[:, None], ((1 - p) * n)[:, None]
            a = ((w1 * yes).sum(0) + 8 * weak) / ((w1 * (yes | no)).sum(0) + 10 * weak)
            b = ((w0 * yes).sum(0) + 2 * weak) / ((w0 * (yes | no)).sum(0) + 10 * weak)
            prior = ((p * n).sum() + weak) / (n.sum() + 2 * weak)
            odds = np.log(prior / (1 - prior)) + (yes * np.log(a / b)).sum(1) + (no * np.log((1 - a) / (1 - b))).sum(1)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            moved, p = np.abs(new - p).max(), new
            if moved < 1e-9:
                break
        self.prior[kind], self.reliability[kind] = float(prior), np.stack([a, b])
        x, w = self._features(shape), np.zeros(self._features(shape[:1]).shape[1])
        scale = n / n.sum()
        for _ in range(50):  # Newton's method with a small ridge
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (scale * (q - p)) + 1e-3 * w
            hess = (x.T * (scale * q * (1 - q))) @ x + 1e-3 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.weights[kind] = w

    @staticmethod
    def _features(shape: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(shape), 1)), shape[:, :-1] == 1, shape[:, :-1] == -1, shape[:, -1:] / 3], 1).astype(float)

    def probability(self, kind: str, shape: tuple[int, ...]) -> float:
        if kind not in self.weights:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self._features(np.array([shape])) @ self.weights[kind], -30, 30)))[0])

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """The base spans, and those that the method adds."""
        base, more, end = base_spans(text), [], -1
        for kind, s, e, shape in sorted(proposals(text, base), key=lambda x: (x[1], -x[2])):
            if s >= end and self.probability(kind, shape) >= 0.5:
                more.append((kind, s, e))
                end = e
        return base, sorted(more)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update((kind, ",".join(map(str, shape))) for kind, _, _, shape in proposals(text, base_spans(text)))
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["kind", "shape", "n"])


def fit(docs: DataFrame) -> Labeling:
    """Counts votes over all texts; what comes to the driver has a row for each pattern of votes and shape."""
    rows = docs.select("text").mapInArrow(_votes, "kind string, shape string, n long").groupBy("kind", "shape").agg(F.sum("n").alias("n")).collect()
    return Labeling({(r["kind"], tuple(map(int, r["shape"].split(",")))): r["n"] for r in rows})


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans counted by kind, base_sha256, and all spans as kind:start:end."""
    labeling = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kept = docs.select("doc_id", "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans = {k: [] for k in BASE}, [], []
            for text in batch.column(1).to_pylist():
                base, more = labeling.value.spans(text or "")
                for k in BASE:
                    counts[k].append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(shas, pa.string()), pa.array(spans, pa.string())], schema.names)

    schema = kept.select("doc_id").schema
    for k in BASE:
        schema = schema.add(f"n_{k}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    return kept.mapInArrow(search, schema)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars, if there, made to agree."""
    labeling = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = docs.columns
    moved = docs.select(*[c for c in names if c != "text"], "text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if text:
                    base, more = labeling.value.spans(text)
                    parts, at = [], 0
                    for kind, s, e in sorted(base + more, key=lambda x: (x[1], -x[2])):
                        if e <= at:
                            continue
                        parts += [text[at : max(at, s)], f"<{kind.upper()}>" if s >= at else ""]
                        at = e
                    text = "".join(parts) + text[at:] if parts else text
                out.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, batch.column(batch.num_columns - 1).type)], batch.schema.names)

    out = moved.mapInArrow(replace, moved.schema).select(*names)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
