"""The pipeline, stage by stage, against a brute-force version; and code lengths against a plain recursion."""

import hashlib
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from cohortlake.llm import language, mixing
from cohortlake.llm._text import plain_shingles
from test_pairs import brute_components
from test_rows import BASE, LANGS, naive_targets, sentence, valid


class Plain:
    """Prediction by partial matching with dictionaries and a recursion, from texts of one language."""

    def __init__(self, texts):
        self.seen = defaultdict(lambda: defaultdict(int))
        for t in texts:
            raw = b"   " + language.normal(t).encode()
            for i in range(3, len(raw)):
                for depth in range(4):
                    self.seen[raw[i - depth : i]][raw[i]] += 1

    def bits(self, context, byte):
        n = self.seen.get(context)
        shorter = 8.0 if not context else None
        if n is None:
            return shorter if shorter is not None else self.bits(context[1:], byte)
        total, distinct = sum(n.values()), len(n)
        if byte in n:
            return math.log2((total + distinct) / n[byte])
        return math.log2((total + distinct) / distinct) + (shorter if shorter is not None else self.bits(context[1:], byte))

    def length(self, text):
        raw = b"   " + language.normal(text).encode()
        return sum(self.bits(raw[i - 3 : i], raw[i]) for i in range(3, len(raw)))


def test_code_lengths_are_those_of_the_recursion():
    rnd = random.Random(1)
    texts = {lang: [sentence(rnd, lang) for _ in range(5)] for lang in LANGS}
    langs, grams, counts = [], [], []
    for i, lang in enumerate(LANGS):
        coded, n = language.grams([language.normal(t) for t in texts[lang]])
        langs.append(np.full(len(n), i))
        grams.append(coded.astype(np.int64))
        counts.append(n.astype(float))
    model = language.Model(list(LANGS), np.concatenate(langs), np.concatenate(grams), np.concatenate(counts))
    asked = [sentence(rnd, lang) for lang in LANGS] + ["xyz", "q", "schön été"]
    got = model.bits([language.normal(t) for t in asked])
    want = [[Plain(texts[lang]).length(t) for lang in LANGS] for t in asked]
    assert np.allclose(got, want, rtol=1e-4)


def documents(rnd):
    texts = []
    for i in range(90):
        lang = list(LANGS)[i % 3]
        words = [w + str() for w in sentence(rnd, lang, 40).split()]
        texts.append((" ".join(words), lang))
    texts += [(t, lang) for t, lang in texts[:8]]
    near = texts[10][0].split()
    near[20] = "und"
    texts += [(" ".join(near), texts[10][1]), ("mail a.b@c.example.com now " + texts[30][0], "aa"), ("12 34", "aa"), ("", "bb"), (None, "cc")]
    return [(i, t, lang, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, (t, lang) in enumerate(texts)]


def naive(rows, items):
    learned = {lang: Plain([r[1] for r in rows if r[1] and r[2] == lang and __import__("zlib").crc32(str(r[0]).encode()) % 4 != 2]) for lang in LANGS}

    def kept(text):
        if not language.normal(text or ""):
            return False
        bits = sorted(p.length(text) for p in learned.values())
        return 1 / sum(2 ** max(-1000.0, bits[0] - b) for b in bits) >= 0.5

    stages = [[r for r in rows if kept(r[1])]]
    label = brute_components([r[1] for r in stages[-1]])
    stages.append([r for i, r in enumerate(stages[-1]) if label[i][1] == i])
    known = [plain_shingles(t) for t in items]
    stages.append([r for r in stages[-1] if not any(len(q & plain_shingles(r[1])) >= 0.8 * len(q) for q in known if q)])

    def redacted(text):
        spans = sorted((m.start(), m.end(), k) for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m.group()))
        out, at = [], 0
        for a, b, k in spans:
            out += [text[at:a], f"<{k.upper()}>"]
            at = b
        return "".join(out) + text[at:]

    stages.append([(i, t2 := redacted(t), lang, source, len(t2)) for i, t, lang, source, _ in stages[-1]])
    sizes = defaultdict(int)
    for _, t, _, source, _ in stages[-1]:
        sizes[source] += len(t.split())
    goal, mixed = naive_targets(dict(sizes)), []
    for r in stages[-1]:
        rate = goal[r[3]] / sizes[r[3]]
        coin = int(hashlib.md5(f"{r[0]}:{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32
        mixed += [(*r, c) for c in range(1, math.floor(rate) + (coin < rate % 1) + 1)]
    stages.append(mixed)
    return stages


@pytest.fixture
def table(spark, tmp_path):
    rnd = random.Random(12)
    rows = documents(rnd)
    items = [rows[40][1][:120], rows[50][1], "not in any text at all"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items, str(tmp_path)


def test_every_stage(spark, table):
    rows, items, at = table
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    key = lambda r: tuple(map(str, r))
    sizes = [len(rows)]
    for n, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, naive(rows, items), strict=True)):
        stage(spark, docs, at).write.parquet(f"{at}/{n}-{name}")
        docs = spark.read.parquet(f"{at}/{n}-{name}")
        last = n == len(corpus_pipeline.STAGES) - 1
        assert docs.columns == columns + (["copy"] if last else [])
        assert sorted(map(tuple, docs.collect()), key=key) == sorted(want, key=key), name
        sizes.append(len(want))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_columns_of_any_name_are_kept(spark, table):
    _, _, at = table
    names = ["__gone", "gone", "again", "__target", "__source", "__size", "__copies", "size", "target", "row", "of", "copies", "copy", "nth", "sid", "__sid", "lang_pred", "score", "__v0"]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = wide.columns
        stage(spark, wide, at).write.parquet(f"{at}/wide-{n}")
        wide = spark.read.parquet(f"{at}/wide-{n}")
        assert wide.columns[: len(before)] == before, name
    assert all(r[n] == f"{n}-{r.doc_id}" for r in wide.collect() for n in names) and wide.columns[-1] == "copy_"


def test_stages_are_run_once(spark, table, monkeypatch):
    _, _, at = table
    want = sorted(map(str, corpus_pipeline.run(spark, at).collect()))
    seen = spark.sparkContext.accumulator(0)

    def counted(spark, docs, sf_dir):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return docs.mapInArrow(count, docs.schema)

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], ("count", counted), *stages[1:]])
    out = corpus_pipeline.run(spark, at)
    assert sorted(map(str, out.collect())) == want
    assert seen.value == language.keep_identified(spark.read.parquet(f"{at}/documents.parquet")).count()


def test_empty_tables(spark, table):
    _, _, at = table
    docs = spark.read.parquet(f"{at}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    assert docs.count() == 0
