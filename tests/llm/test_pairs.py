"""Operators on pairs and repeats, against brute force."""

import hashlib
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlake.llm import _shared, decontamination, prefixjoin, suffixes, topk
from cohortlake.llm._text import plain_shingles


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=3, families=6):
    """Texts with exact and near copies, a passage that many share, short, empty and null ones, and a long one."""
    rnd, out = random.Random(seed), [None, "", " \t\n", "one", "one", "two words", "one two three four five", "ONE two three four five"]
    passage = words(rnd, 40)
    for _ in range(families):
        base = words(rnd, rnd.randrange(30, 120))
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(copy))
        out += [" ".join(base)] * 3
    out += [" ".join(words(rnd, 60) + passage + words(rnd, 60)) for _ in range(15)]
    out.append(" ".join(words(rnd, 30_000, 10**6)))
    rnd.shuffle(out)
    return out


def brute_components(texts):
    sets = {i: plain_shingles(t) for i, t in enumerate(texts)}
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in sets:
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("block", [3, 256])
def test_prefix_join(spark, frame, monkeypatch, block):
    texts = corpus()
    monkeypatch.setattr(prefixjoin.set_components, "__defaults__", (prefixjoin.SIMILARITY, block))
    monkeypatch.setattr(prefixjoin.hot_shingles, "__defaults__", (2, 0.05, 4))
    monkeypatch.setattr(prefixjoin.shared_sets, "__defaults__", (prefixjoin.SIMILARITY, 3000, None))
    rows = prefixjoin.linked(frame(*enumerate(texts))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_no_table_of_unproven_size_goes_through_the_driver(spark, frame, monkeypatch):
    texts, plans, keep = corpus(families=2), [], _shared.store

    def store(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(prefixjoin, "store", store)
    monkeypatch.setattr(_shared, "few", lambda df: False)  # as if every table were large, while Spark takes them to be small
    monkeypatch.setattr(prefixjoin.set_components, "__defaults__", (prefixjoin.SIMILARITY, 3))
    monkeypatch.setattr(prefixjoin.components, "__defaults__", (0,))
    docs = frame(*enumerate(texts), (0, "one more row of this id"))
    found, kept = prefixjoin.linked(docs), prefixjoin.deduplicated(docs)
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (found, kept)]
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not [p for p in plans if "Broadcast" in p]
    assert {r.doc_id: r.component_id for r in found.collect()}.items() >= {i: c for i, (_, c) in brute_components(texts).items() if i}.items()


@pytest.mark.parametrize(("block", "whole"), [(4, False), (4, True), (256, False)])
def test_sets_of_a_shingle_meet(spark, block, whole):
    """The last step by itself, no link known before but one: sets of many sizes over few shingles, most of them unlinked."""
    rnd, sets = random.Random(block), []
    top = 60 if whole else 20_000  # of few shingles, each is in many sets, so all meet at once
    for _ in range(12):
        base = rnd.sample(range(1, top), rnd.choice((5, 9, 12, 20, 40)))
        for _ in range(8):
            sets.append(frozenset(base[rnd.randrange(3) :]) | set(rnd.sample(range(1, top), rnd.randrange(4))))
    rows = []
    for i, s in enumerate(sets):
        prefix = len(s) - -(-80 * len(s) // 100) + 1
        rows.append((i, len(s), np.array(sorted(s), np.uint64).tobytes(), prefix, 7, i))
    rows[1] = (*rows[1][:5], 0)
    big = prefixjoin.store(spark.createDataFrame(rows, "sid long, n long, tokens binary, prefix int, family long, label long"))
    edges = {(r.a, r.b) for r in prefixjoin._between(big, prefixjoin.SIMILARITY, block).collect()} | {(1, 0)}

    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            x, y = label[a], label[b]
            label = [min(x, y) if z in (x, y) else z for z in label]
        return label

    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 100 * len(a & b) >= 80 * len(a | b)]
    assert groups(edges) == groups([*links, (1, 0)])
    assert len(set(groups(edges))) > 12


def test_prefix_join_edges(frame):
    assert prefixjoin.linked(frame((1, "a b")).where("false")).count() == 0
    rows = prefixjoin.linked(frame((5, None), (6, ""), (6, ""), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"))).collect()
    assert sorted(((r.doc_id, r.component_id, r.n_shingles) for r in rows), key=str) == sorted([(5, 5, 0), (6, 6, 0), (6, 6, 0), (None, 9, 2), (9, 9, 2), (9, 9, 2)], key=str)


def test_one_of_each_group_stays(frame):
    docs = frame((4, "a b c d e f g"), (2, "a b c d e f g"), (7, "z"), (7, "z"), (8, None), (8, ""), (None, "a b c d e f g"))
    kept = prefixjoin.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "7", "8", "8", "None"]


def test_rows_of_one_id_go_by_their_texts(spark):
    long = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    near = long.replace("z", "zz")
    rows = [(1, long, "p"), (2, near, "q"), (2, "something else that nobody says twice", "r"), (3, "one two three four five six", "s"), (3, "one two three four five six", "t"), (3, "one two three four five seven eight nine ten", "u"), (5, near, "v"), (5, long, "w")]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "doc_id long, text string, other string, __gone int, gone int, again int, sid int, whole int")
    kept = prefixjoin.deduplicated(docs)
    assert kept.columns == docs.columns
    # 3 has two sets that are not linked, and each is first in its group
    assert sorted((r.doc_id, r.other) for r in kept.collect()) == [(1, "p"), (2, "r"), (3, "s"), (3, "u")]


def test_sets_that_agree_in_one_hash(spark, frame, monkeypatch):
    texts = ["a b c d e f", "one two three four five", "a b c d e f"]
    real = prefixjoin.digests
    # all sets have one first hash, until they are renamed
    same = lambda docs, renamed=None: real(docs, renamed) if renamed is not None else real(docs).withColumn("sid", F.lit(7).cast("long"))
    monkeypatch.setattr(prefixjoin, "digests", same)
    own, classes, renamed = prefixjoin.classes_of(frame(*enumerate(texts)))
    assert renamed.tolist() == [7] and classes.count() == 2
    buf, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.array([0, 11, 34, 45])
    _, _, sid, other = prefixjoin.sets(buf, offsets)
    again = prefixjoin.sets(buf, offsets, np.sort(sid[:1]))[2]
    assert again.tolist() == [other[0], sid[1], other[2]] and sid[0] == sid[2] != sid[1]


def test_buckets_with_many_classes():
    rnd = np.random.default_rng(3)
    h, number = rnd.integers(0, 40, 500).astype(np.uint64), rnd.integers(0, 90, 500)
    want = prefixjoin._shared(h, number)
    for a, b in zip(want, prefixjoin._shared(h, number, 6), strict=True):
        assert a.tolist() == b.tolist()
    assert len(want[0]) and (want[2] > 1).all()


def test_long_texts_are_worked_on_in_slices(monkeypatch):
    from cohortlake.llm import _text

    rnd = random.Random(5)
    text = " ".join(words(rnd, 3000)) + "  É\tÀb " + "y" * 700 + " end"
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.array([0, len(raw)])
    whole, plain = _text.shingles(raw, at)[0], plain_shingles(text)
    monkeypatch.setattr(_text, "PIECE_BYTES", 100)
    assert _text.shingles(raw, at)[0].tolist() == whole.tolist()
    assert len(set(whole.tolist())) == len(plain)
    monkeypatch.setattr(_text.word_runs, "__defaults__", (5, 64))
    assert _text.plain_shingles(text) == plain
    some = set(random.Random(1).sample(sorted(plain), 10)) | {("not", "in", "it", "at", "all"), ("end",)}
    assert _text.plain_shingles(text, wanted=some) == some & plain
    assert _text.plain_shingles("a  b", wanted={("a", "b")}) == {("a", "b")} and _text.plain_shingles(" \n") == set()


def brute_removal(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        own = [raw[j : j + 50] for j in range(len(raw) - 49)]
        cover = bytearray(len(raw))
        for j, w in enumerate(own):
            if w in seen:
                cover[j : j + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        spans = sum(1 for j in range(len(cover)) if cover[j] and not (j and cover[j - 1]))
        out[i] = (len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest())
        seen.update(own)
    return out


def repeats():
    texts = corpus(8, 3)
    rnd = random.Random(1)
    texts += ["é" * 60, "ab" * 200, "a" * 49, "a" * 50, "a" * 51, "a" * 500, " ".join(words(rnd, 400)) + "aé" * 40, "x" * 25 + texts[20][:49] + "y" * 30]
    return texts


@pytest.mark.parametrize(("piece", "least", "merged"), [(1500, 3, 2), (1500, 2000, 1), (2_000_000, 3, 1)])
def test_suffixes(spark, frame, monkeypatch, piece, least, merged):
    texts = repeats() + [f"{i} before it " * (i % 4) + "one line that is in every text and has more bytes than a window, so that it goes" + f" and {i} after it" * (i % 3) for i in range(60)]
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffixes, "slices", _slices(piece))
    monkeypatch.setattr(suffixes.hot_minimizers, "__defaults__", (1, least))
    if merged > 1:
        monkeypatch.setattr(suffixes.removed_spans, "__defaults__", (3,))
    rows = suffixes.removal(frame(*enumerate(texts)).repartition(3), 500, 50, 10 if merged > 1 else 10**9).collect()
    want = brute_removal(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_rows_of_one_id_are_cut_each_for_itself(frame):
    rnd = random.Random(3)
    one, two = " ".join(words(rnd, 40, 10**6)), " ".join(words(rnd, 30, 10**6))
    rows = suffixes.removal(frame((1, one), (2, one[:90] + "z" * 5), (2, two), (2, one), (3, two))).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in rows)
    assert got == sorted([(1, len(one), 0), (2, 95, 90), (2, len(two), 0), (2, len(one), len(one)), (3, len(two), len(two))])


def test_minimizers_with_many_classes():
    rnd = np.random.default_rng(3)
    h, number = rnd.integers(0, 40, 300).astype(np.uint64), rnd.integers(0, 90, 300)
    for a, b in zip(suffixes._several(h, number), suffixes._several(h, number, 6), strict=True):
        assert a.tolist() == b.tolist() and len(a)


def _slices(piece):
    def slices(text):
        for lo, _, buf, offsets in suffixes.pieces(text, piece):
            if len(offsets) == 2 and len(buf) > 2 * piece:
                for at in range(0, len(buf) - suffixes.DEPTH + 1, piece):
                    part = buf[at : at + piece + suffixes.DEPTH - 1]
                    yield lo, at, part, np.array([0, len(part)])
            else:
                yield lo, 0, buf, offsets

    return slices


def test_suffix_edges(frame):
    assert suffixes.removal(frame((1, "a")).where("false")).count() == 0
    long = "q" * 10 + "".join(chr(97 + i % 26) for i in range(100))
    rows = suffixes.removal(frame((3, long), (3, long), (4, long), (None, long), (5, None))).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in rows) == [("3", 0, 0), ("3", 0, 0), ("4", 110, 1), ("5", 0, 0), ("None", 0, 0)]


def test_decontamination(frame, spark):
    rnd = random.Random(4)
    items = [" ".join(words(rnd, n)) for n in (1, 3, 5, 6, 12, 30, 80)] + ["", None]
    broken = items[6].split()
    broken[40] = "other"
    texts = [None, "", items[0], items[1], "x " + items[1], "pre " + items[2].upper() + " post", " ".join(words(rnd, 2000)) + " " + items[4] + " " + " ".join(words(rnd, 2000)), " ".join(["a", *broken, "b"]), items[5][: len(items[5]) // 2], " ".join(words(rnd, 500))]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            q = plain_shingles(item)
            if q and len(q & plain_shingles(t)) >= 0.8 * len(q):
                want.add((i, j))
    assert len(want) > 4
    for part in (decontamination.PART, 3):
        got = decontamination.find(frame(*enumerate(texts)), bench, part=part)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
        kept = decontamination.clean(frame(*enumerate(texts)), bench, part=part)
        assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    none = bench.where("false")
    assert decontamination.find(frame((1, "a")), none).count() == 0
    assert decontamination.clean(frame((1, "a")), none).count() == 1


@pytest.mark.parametrize(("n", "edits"), [(5, ()), (7, ()), (8, ()), (14, (0, 13)), (54, (20, 30))])
def test_items_are_found_as_often_as_stated(n, edits):
    """Items of 1, 3, 4, 10 and 50 shingles inside long texts; the longer ones with words changed until they have 0.8 of their shingles left."""
    import pyarrow as pa
    from cohortlake.llm._text import pieces

    rnd, missed, trials = random.Random(n), 0, 0
    for _ in range(4):  # new items, as the seeds are fixed
        items = [[f"i{rnd.getrandbits(40)}" for _ in range(n)] for _ in range(1000)]
        index = decontamination.Index(list(range(1000)), [" ".join(item) for item in items])
        texts = []
        for item in items:
            rest = [f"w{rnd.getrandbits(40)}" for _ in range(404 - n)]
            at = rnd.randrange(len(rest))
            texts.append(" ".join([*rest[:at], *[w if i not in edits else "e" + w for i, w in enumerate(item)], *rest[at:]]))
        assert len(plain_shingles(" ".join(items[0])) & plain_shingles(texts[0])) >= 0.8 * (n - 4)
        for lo, hi, buf, offsets in pieces(pa.array(texts, pa.large_string())):
            found = index.candidates(buf, np.asarray(offsets))
            missed += sum((i - lo, i) not in found for i in range(lo, hi))
            trials += hi - lo
    assert trials == 4000 and missed <= (1 - decontamination.COLLISION) * trials


def test_repeated_items_match_each_for_itself(frame, spark):
    bench = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f")], "item_id long, text string")
    docs = frame((7, "x a b c d e f y"), (8, "g h i j k l"), (8, "g h i j k l"))
    for part in (decontamination.PART, 1):
        got = sorted((r.doc_id, r.item_id, r.shared) for r in decontamination.find(docs, bench, part=part).collect())
        assert got == [(7, 1, 2), (7, 1, 2), (7, 2, 2), (8, 1, 2), (8, 1, 2)]
        assert decontamination.clean(docs, bench, part=part).count() == 0


@pytest.mark.parametrize(("block", "group_bytes"), [(7, 200), (4096, 1 << 20)])
def test_top_k(spark, block, group_bytes):
    rnd = np.random.default_rng(2)
    vectors = {int(i) * 50: rnd.normal(size=6).round(2) for i in range(60)}
    vectors[150] = vectors[100]
    vectors[200] = np.zeros(6)
    rows = [(i, [float(x) for x in v], 1, 2) for i, v in vectors.items()] + [(300_000, None, 1, 2), (400_000, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 2), (500_000, [float("nan")] * 6, 1, 2), (600_000, [1.0, 2.0], 1, 2), (None, [0.0] * 6, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, number int")
    scaled = topk.scaled(df)
    got = topk.search(scaled, scaled.where("id % 100 = 0").withColumnRenamed("id", "query_id"), 5, block, group_bytes).collect()
    whole = {i: np.floor(1024 * v).astype(int) for i, v in vectors.items()}
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"], r.id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.neighbours(df.where("false")).count() == 0


def test_repeated_queries_have_a_list_each(spark):
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), *[(i, [float(i), -float(i)]) for i in range(1, 30)], (5, [5.0, -5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.neighbours(df, 3).collect())
    first = [(1, 29, 29 * 1024**2), (2, 28, 28 * 1024**2), (3, 27, 27 * 1024**2)]
    second = [(1, 1, -(1024**2)), (2, 2, -2 * 1024**2), (3, 3, -3 * 1024**2)]
    assert got == sorted(first + second * 2)


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e18, 1e18]), (1, [1e18, 1e18]), (2, [-1e18, -1e18]), (3, [1e300, 1.0]), (4, [3e6, 3e6]), (5, [1e-9, -1e18])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    most = (1 << 63) - 1
    component = lambda x: max(-most - 1, min(int(math.nextafter(2.0**63, 0)), math.floor(x * 1024)))
    whole = {i: [component(x) for x in v] for i, v in rows}
    want = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(whole[0], v, strict=True)))), i) for i, v in whole.items() if i)
    assert [(-r.score, r.vec_id) for r in topk.neighbours(df).orderBy("rank").collect()] == want


def test_threshold_stops_early():
    rnd = np.random.default_rng(1)
    lists = topk.Lists(np.arange(5000), (rnd.normal(size=(5000, 2)) * 1000).astype(np.int64))
    seen, scores = [], lists.scores
    lists.scores = lambda rows, q: (seen.append(len(rows)), scores(rows, q))[1]
    query = np.array([3, -2])
    ids, best = lists.top(-1, query, 5)
    every = Counter({i: int(s) for i, s in enumerate(lists.vectors @ query)})
    assert best.tolist() == [s for _, s in every.most_common(5)]
    assert sum(seen) < 2500
    # a better kth score from an earlier block leaves nothing to read
    seen.clear()
    lists.top(-1, query, 5, ids + 10_000, best + 10_000)
    assert not seen


def test_a_bucket_is_met_in_little_memory():
    """Against counting, and a bucket of BUCKET shingles' share of memory."""
    rnd = np.random.default_rng(4)

    def dealt(n, share):
        ids, rows = rnd.integers(1, 1 << 63, n // 20).astype(np.uint64), []
        for part in np.array_split(ids, 12):
            h = np.where(rnd.random(20 * len(part)) < share, rnd.integers(0, n // 9, 20 * len(part)), rnd.integers(0, 1 << 40, 20 * len(part))).astype(np.uint64)
            rows.append((5, 0, prefixjoin._low(h), part.tobytes(), prefixjoin._counts(np.full(len(part), 20))))
        rows.append(rows[0])  # a copy of a class's text in another piece
        return pa.Table.from_batches([prefixjoin._record(r, prefixjoin._DEALT) for r in (rows[:5], rows[5:])])

    for n, groups in ((4000, 3), (4000, 40)):
        table = dealt(n, 0.5)
        h, sid = prefixjoin._unpack(table)
        owners = defaultdict(set)
        for x, s in zip(h.tolist(), sid.tolist(), strict=True):
            owners[x].add(s)
        want = {(x, s, int(prefixjoin._rank(np.array([len(o)]))[0])) for x, o in owners.items() if len(o) > 1 for s in o}
        rows = prefixjoin._met(table, groups)
        got = []
        for g, bucket, low, df, ids, count, _ in rows:
            ids = np.frombuffer(ids, np.uint64)
            assert bucket == 5 and (prefixjoin._group(ids, groups) == g).all()
            got += zip(prefixjoin._high(low).tolist(), np.repeat(ids, prefixjoin._counted(count, len(ids))).tolist(), np.frombuffer(df, np.uint8).tolist(), strict=True)
        assert len(got) == len(want) and set(got) == want and len({r[0] for r in rows}) == len(rows)
    table = dealt(1_000_000, 0.15)
    tracemalloc.start()
    prefixjoin._met(table, 40)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * 1_000_000  # 50 bytes a shingle when a bucket was unpacked as a whole


def test_small_graphs_take_few_jobs(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(-100, 100 + i) for i in range(30)] + [(rnd.randrange(200, 500), rnd.randrange(200, 500)) for _ in range(250)]
    frame = spark.createDataFrame(edges, "a long, b long")
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    group = "components"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {r.node: r.label for r in prefixjoin.components(frame).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == label and jobs < 12  # some 60 by rounds of stars
    assert {r.node: r.label for r in prefixjoin.components(frame, 0).collect()} == label  # larger graphs go by rounds


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100 + i, 100) for i in range(1, 40)] + [(5, 5)]
    got = prefixjoin.components(spark.createDataFrame(chain, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(40)}
    assert prefixjoin.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got.select(F.count("*")).first()[0] == 71
