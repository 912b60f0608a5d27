"""Centroid clustering (11) and whitening (13) against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from test_contracts import SMALL

from recollect.llm import centroids, vectors, whitening
from recollect.llm.queries import QUERIES

ODD = "vec_id long, embedding array<float>, label string, x int, cluster string, near int, n string, slot int, rest string"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "l", 1, "c", 2, "n", 3, "r") for r in rows], ODD.replace("float", kind))


def odd_rows(width=64, count=300, seed=3):
    r = random.Random(seed)
    vec = lambda: [r.gauss(r.choice((0, 0.5)), 0.25) for _ in range(width)]
    rows = [(i, vec()) for i in range(count)]
    rows += [(3, vec()), (3, vec()), rows[5], rows[5], (None, vec()), (None, None), (900, None), (901, []), (902, vec()[1:]),
             (903, [*vec()[1:], None]), (904, [*vec()[1:], math.nan]), (905, [*vec()[1:], math.inf]), (906, [0.0] * width)]
    return rows + [(i, rows[7][1]) for i in range(1000, 1200)]


def single(x):
    return float(np.float32(x))


def brute_clusters(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * single(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centre = [v for _, v in sorted(kept, key=lambda p: (digest(p[0]), p[1]))[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))

    def place():
        return [min((far(v, c), j) for j, c in enumerate(centre)) for _, v in kept]

    for _ in range(rounds):
        at = [j for _, j in place()]
        for j in range(len(centre)):
            mine = [v for (_, v), a in zip(kept, at) if a == j]
            if mine:
                centre[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = place()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted((repr(i), j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, found))


def clusters(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((repr(r[0]), *r[1:]) for r in df.collect())


def test_clusters_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert clusters(QUERIES["op11_centroids"](spark, SMALL)) == brute_clusters(rows)


def test_clusters_of_odd_rows(spark):
    rows = odd_rows()
    assert clusters(centroids.cluster(table(spark, rows))) == brute_clusters(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(20)]])
def test_clusters_of_few_rows(spark, rows):
    assert clusters(centroids.cluster(table(spark, rows))) == brute_clusters(rows)


def test_clusters_beyond_small_numbers(spark):
    """Components whose squares pass 64 bits are measured exactly, without the filter."""
    rows = [(i, [1e15 + 7.0 * i * (j + 1) for j in range(4)]) for i in range(40)]
    got = centroids.cluster(table(spark, rows, "double"), k=3, width=4).collect()
    kept = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    centre = {}
    for r in got:
        centre.setdefault(r["cluster"], []).append(r["vec_id"])
    shas = {r["cluster"]: r["centroid_sha256"] for r in got}
    settled = {j: [sum(c) // len(ids) for c in zip(*[kept[i] for i in ids])] for j, ids in centre.items()}
    assert shas == {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in settled.items()}
    assert all(r["distance"] == min((1 << 63) - 1, sum((a - b) ** 2 for a, b in zip(kept[r["vec_id"]], settled[r["cluster"]]))) for r in got)


def test_filter_measures_few_and_misses_none():
    r = np.random.default_rng(1)
    middle = r.normal(0, 700, (20, 64))
    x = np.floor(middle[r.integers(0, 20, 4000)] + r.normal(0, 60, (4000, 64)))
    rotation = centroids.Rotation(x.mean(0), np.cov(x.T, bias=True), 16)
    centre = [[int(v) for v in c] for c in np.floor(middle)]
    at, distance, measured = centroids.nearest(x, *rotation(x), centre, rotation)
    true = ((x[:, None, :].astype(np.int64) - np.array(centre)[None]) ** 2).sum(2)
    assert (distance == true.min(1)).all() and (at == true.argmin(1)).all()
    assert measured < 1.2 * len(x)  # of 20 each


def test_limbs():
    for v in (0, 1, -1, 2 ** 31, -2 ** 31 - 1, 2 ** 63, -2 ** 64, 3 ** 90, -3 ** 90):
        b = vectors.limbs([0, v, 5]).to_pydict()
        assert sum(p << (32 * at) for s, at, p in zip(b["slot"], b["limb"], b["part"]) if s == 1) == v


# 13 whitening

def brute_whitening(rows, top=32):
    """Exact sums, a covariance centred before multiplying, and its eigenvectors."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [[math.floor(64 * single(c)) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[n * a - s for a, s in zip(v, sums)] for v in x], np.float64) / n
    v = y.T @ y / n
    e, b = np.linalg.eigh(v)
    return good, n, [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x], y, e[::-1][:top], b[:, ::-1][:, :top], np.trace(v)


def check_whitening(df, rows):
    good, n, deviation, y, e, b, trace = brute_whitening(rows)
    got = df.toPandas()
    top = int((e > e[0] * 1e-11).sum())
    assert len(got) == len(good) * top and set(got["n"]) == {n} and got["identity_error"].nunique() == 1
    assert got["identity_error"].max() <= 1e-4
    assert Counter(zip(map(repr, got["vec_id"].astype(object).where(got["vec_id"].notna(), None)), got["deviation"])) == Counter(
        {k: top * c for k, c in Counter((repr(i if i is None else float(i) if got["vec_id"].dtype == float else i), d)
                                        for (i, _), d in zip(good, deviation)).items()})
    share = got.groupby("component")["explained"].agg(["min", "max"])
    assert (share["min"] == share["max"]).all() and np.allclose(share["min"].to_numpy(), e[:top] / trace, rtol=1e-6)
    for j in range(top):
        mine = np.sort(got[got["component"] == j + 1]["whitened"].to_numpy())
        want = y @ b[:, j] / np.sqrt(e[j])
        alone = min(abs(e[j] - o) for k, o in enumerate(e) if k != j) > 1e-6 * e[0]  # else any basis of the two is right
        assert not alone or np.allclose(mine, np.sort(want), atol=1e-6) or np.allclose(mine, np.sort(-want), atol=1e-6)


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(QUERIES["op13_whitening"](spark, SMALL), rows)


def test_whitening_of_odd_rows(spark):
    rows = odd_rows(width=8)
    df = whitening.whiten(table(spark, rows))
    check_whitening(df, rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(i, [0.5, 1.0]) for i in range(9)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(table(spark, rows)).collect() == []


def test_whitening_of_dependent_dimensions(spark):
    r = random.Random(2)
    rows = [(i, [a := r.random(), a, 0.5, r.random()]) for i in range(50)]
    check_whitening(whitening.whiten(table(spark, rows)), rows)


def test_polarisation_is_exact():
    """Covariances of numbers whose squares pass 64 bits, from squares only."""
    r = random.Random(4)
    x = [[10 ** 12 + r.randint(-10 ** 11, 10 ** 11) * (j + 1) for j in range(3)] for _ in range(30)]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centre = [s // n for s in sums]
    z = whitening._centred(np.array(x, np.float64), np.array(centre, np.float64))
    squares = whitening._squares(z)
    got = whitening.covariance(n, sums, centre, squares[:3], squares[3:])
    for i in range(3):
        for j in range(3):
            exact = sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in x)
            assert got[i, j] == exact / n ** 3
