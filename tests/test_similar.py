"""Similar pairs, groups and neighbours against brute force."""
import random
from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import approximate as A
from recollect.operators import retrieval as R
from recollect.operators import similar as SM
from recollect.sources import views


def brute_sets(rows, threshold):
    """(classes, pairs) of (key, words)."""
    classes = {}
    for k, w in rows:
        if k is not None and w:
            s = frozenset(w)
            classes[s] = min(classes.get(s, k), k)
    items = sorted((k, s) for s, k in classes.items())
    t = Fraction(str(threshold))
    pairs = {(a, b, len(s & r)) for i, (a, s) in enumerate(items) for b, r in items[i + 1:] if Fraction(len(s & r), len(s | r)) >= t}
    return classes, pairs


def brute_groups(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", T.word_set("text").alias("w"))
    return [(r["doc_id"], r["w"]) for r in docs.collect()]


def random_sets():
    r = random.Random(2)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randint(1, 40))] for _ in range(60)]
    rows = []
    for i in range(400):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"w{r.randrange(400)}"
        rows.append((i, w))
    return rows + [(500, []), (501, None), (None, ["w1"]), (502, ["w1", None, "w1"]), (3, ["w2", "w3"]), (503, rows[7][1]), (504, rows[7][1][::-1])]


@pytest.mark.parametrize("which", ["documents", "random"])
@pytest.mark.parametrize("threshold", [0.85, 0.6, 1.0])
def test_similar_sets(spark, monkeypatch, which, threshold):
    rows = texts(spark) if which == "documents" else random_sets()
    monkeypatch.setattr(SM, "COPIES", 2)  # the classes of several rows go the broadcast way
    pairs, members = SM.similar_sets(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", threshold)
    classes, want = brute_sets(rows, threshold)
    got = pairs.collect()
    assert {(r["a"], r["b"], r["common"]) for r in got} == want and len(got) == len(want)
    assert sorted(map(tuple, members.collect())) == sorted((k, classes[frozenset(w)]) for k, w in rows if k is not None and w)
    if threshold == 0.6:
        out = SM.linked(pairs, members).collect()
        group = brute_groups(classes.values(), [(a, b) for a, b, _ in want])
        assert all(r["component_id"] == group[r["class_id"]] for r in out)
        assert all(r["links"] == sum(r["class_id"] in p[:2] for p in want) for r in out)


@pytest.mark.parametrize("rows", [[], [(1, [])], [(1, ["a"])]])
def test_similar_sets_of_few_rows(spark, rows):
    pairs, members = SM.similar_sets(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w")
    assert pairs.collect() == [] and SM.linked(pairs, members).count() == sum(bool(w) for _, w in rows)


@pytest.mark.parametrize("radius", [0, 3, 10])
@pytest.mark.parametrize("group", [64, 0.001])
def test_near_hashes(spark, monkeypatch, radius, group):
    """With few and with many blocks that must agree."""
    monkeypatch.setattr(SM, "GROUP", group)
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    values = [r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for _ in range(300)]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)] + [(900, 5), (901, 5), (None, 5), (902, None)]
    pairs, members = SM.near_hashes(spark.createDataFrame(rows, "k long, h long"), "k", "h", radius)
    classes = {}
    for k, v in rows:
        if k is not None and v is not None:
            classes[v] = min(classes.get(v, k), k)
    items = sorted((k, v) for v, k in classes.items())
    want = {(a, b, d) for i, (a, v) in enumerate(items) for b, u in items[i + 1:] if (d := ((v ^ u) & (2 ** 64 - 1)).bit_count()) <= radius}
    got = pairs.collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
    group = brute_groups(classes.values(), [(a, b) for a, b, _ in want])
    out = SM.linked(pairs, members).collect()
    assert sorted((r["key"], r["class_id"], r["component_id"]) for r in out) == sorted(
        (k, classes[v], group[classes[v]]) for k, v in rows if k is not None and v is not None)


def test_components_of_a_long_chain(spark):
    order = list(range(600))
    random.Random(1).shuffle(order)
    edges = [tuple(sorted(p)) for p in zip(order, order[1:])]
    out = SM.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(out) == 600 and {r["component_id"] for r in out} == {0}


@pytest.mark.parametrize("n", [1500, 6000])
def test_approx_knn_recall(spark, n):
    r = np.random.default_rng(n)
    centres = r.normal(size=(40, 24))
    v = centres[r.integers(0, 40, n)] + 0.4 * r.normal(size=(n, 24))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(n, None), (n + 1, [0.0]), (n + 2, [None] * 24)]
    vectors = spark.createDataFrame(rows, "seq long, embedding array<double>")
    queries = vectors.filter("seq % 50 = 0").withColumnRenamed("seq", "query_id")
    key = lambda df: {(r["query_id"], r["seq"]) for r in df.collect()}
    true, found = key(R.knn(vectors, queries, 10)), key(A.approx_knn(vectors, queries, 10, bits=6))
    assert len(found & true) >= 0.9 * len(true)
    assert key(A.approx_knn(vectors, queries, 10, target=1.0, bits=3)) >= set(sorted(true)[:100])


def test_approx_knn_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 50)  # the one bucket is met in chunks
    vectors = spark.range(700).select(F.col("id").alias("seq"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    queries = vectors.filter("seq < 3").withColumnRenamed("seq", "query_id")
    got = A.approx_knn(vectors, queries, 4).select("query_id", "seq", "rank").collect()
    assert sorted(map(tuple, got)) == [(q, s, s + 1) for q in range(3) for s in range(4)]
    assert A.approx_knn(vectors, queries.limit(0), 4).collect() == []


def test_subject_counts_are_exact(spark):
    """Bitmaps over several ranges of keys, with nulls, repeats and negative keys."""
    from recollect.operators import jobs as Q
    asks = spark.createDataFrame([("tell me about Ada Lovelace", "2024-01-01 00:00:00"), ("who is Ada?", "2024-01-02 00:00:00"),
                                  ("who is Bob?", "2024-01-03 00:00:00")], "text string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    docs = spark.range(-40_000, 40_000, 7).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'ada, (ADA) wrote' WHEN id % 3 = 0 THEN 'Lovelace.' ELSE 'nothing' END AS text")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, "ada"), (1, None)], "doc_id long, text string"))
    got = {r["subject"]: r["docs"] for r in Q.subject_index(asks, docs).collect()}
    ids = range(-40_000, 40_000, 7)
    assert got == {"Ada Lovelace": sum(i % 2 == 0 or i % 3 == 0 for i in ids), "Ada": sum(i % 2 == 0 for i in ids), "Bob": 0}
    assert views.PARTS > 0


def test_subject_counts_need_no_bits_for_each_subject(spark, monkeypatch):
    """Common and rare words, several parts of the sets, unions that overlap; bits stay in the ranges of documents."""
    from recollect.operators import jobs as Q
    names = ["Ada", "Bob", "Cyd", "Ada Bob", "Ada Cyd", "Bob Cyd", "Ada Bob Cyd", "Ada Zed"]
    asks = spark.createDataFrame([(f"who is {n}?", "2024-01-01 00:00:00") for n in names], "text string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    holds = {"Ada": lambda i: i % 3 == 0, "Bob": lambda i: i % 1000 == 0, "Cyd": lambda i: i % 900 == 0, "Zed": lambda i: False}
    docs = spark.range(70_000).selectExpr("id AS doc_id", """concat_ws(' ', CASE WHEN id % 3 = 0 THEN 'ada' END,
        CASE WHEN id % 1000 = 0 THEN 'bob' END, CASE WHEN id % 900 = 0 THEN 'cyd' END) AS text""")
    want = {n: sum(any(holds[w](i) for w in n.split()) for i in range(70_000)) for n in names}
    for sets in (10, 2):
        out = Q.subject_index(asks, docs, set_rows=sets)
        assert "bitmap_or_agg" not in out._jdf.queryExecution().toString()
        assert {r["subject"]: r["docs"] for r in out.collect()} == want
    monkeypatch.setattr(Q, "DENSE", 100_000)
    assert {r["subject"]: r["docs"] for r in Q.subject_index(asks, docs, used_words=1).collect()} == want


def test_near_hashes_of_a_hot_key_meet_in_chunks(spark, monkeypatch):
    """Hashes meet as arrays, not as joined rows; a key of many hashes is cut, and no pair is lost or doubled."""
    r = random.Random(5)
    values = sorted({r.getrandbits(9) for _ in range(300)} | {r.getrandbits(63) for _ in range(50)})
    rows = spark.createDataFrame(list(enumerate(values)), "k long, h long")
    want = sorted((a, b, d) for a, v in enumerate(values) for b in range(a + 1, len(values)) if (d := (v ^ values[b]).bit_count()) <= 2)
    for chunk, tile in ((100_000, 1024), (20, 7)):
        monkeypatch.setattr(SM, "CHUNK", chunk)
        monkeypatch.setattr(SM, "TILE", tile)
        pairs, _ = SM.near_hashes(rows, "k", "h", 2)
        assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString() or chunk == 20
        assert sorted(map(tuple, pairs.collect())) == want


def test_similar_sets_of_a_cut_family(spark, monkeypatch):
    """A family of more words than meet at once is cut into chunks; a set is not sent for each pair."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, [*base[:i % 7], *base[i % 7 + 1:], f"own{i}", None]) for i in range(60)]
    _, want = brute_sets(rows, 0.85)
    monkeypatch.setattr(SM, "OFTEN", 64)  # most words share a place with others
    for family in (1 << 20, 1500):
        monkeypatch.setattr(SM, "FAMILY", family)
        sets = []
        met = SM._met

        def counted(found, whole):
            grouped = met(found, whole)
            sets.append(grouped.agg(F.count_if(F.col("b").isNull()).alias("n")).agg(F.sum("n")).first()[0])
            return grouped

        monkeypatch.setattr(SM, "_met", counted)
        pairs, _ = SM.similar_sets(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w")
        got = pairs.collect()
        monkeypatch.setattr(SM, "_met", met)
        assert {(r["a"], r["b"], r["common"]) for r in got} == want and len(got) == len(want) > 1000
        assert sets[0] <= 10 * len(rows)
