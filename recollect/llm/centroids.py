"""Clustering around centroids, in whole numbers, with a PCA-rotated filter.

Every vector is stored once with its leading coordinates in the basis of the principal
components and the length of the rest. For a centroid stored in the same way, the squared
distance of the leading coordinates plus the squared difference of the two lengths is a
lower bound of the squared distance. A round measures the centroid of the least bound in
integers and then only those others whose bound does not exceed that distance.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm.common import is_empty, stored
from recollect.llm.vectors import LIMBS, as_long, finite, limbs, list_column, summed, whole

ROWS = 4096   # vectors measured at once
SLACK = 1e-9  # share of both squared lengths that a bound may lack by rounding


def whole_vectors(vectors, width, scale):
    """`vec_id`, `x` array<double> holding floor(scale * component), for the vectors with
    exactly `width` components, none null or non-finite."""
    schema = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).schema

    def run(batches):
        for b in batches:
            rows, sizes, flat = finite(b.column(1))
            fits = sizes == width
            x = np.floor(scale * flat[np.repeat(fits, sizes)]).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[fits])), list_column(x)], names=["vec_id", "x"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).mapInArrow(run, schema)


def matrix(column, width):
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def pieces(batches):
    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            yield b.slice(start, ROWS)


def moments(rows, width):
    """(mean, second moments) of all vectors, in doubles: they choose a basis, no result
    depends on their rounding."""
    places = width * (width + 1)

    def run(batches):
        total = np.zeros(places + 1)
        for b in pieces(batches):
            x = matrix(b.column(1), width)
            total += np.concatenate((x.sum(0), (x.T @ x).ravel(), [len(x)]))
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(places + 1, dtype=np.int32)), pa.array(total)],
                                             names=["slot", "value"])

    total = np.zeros(places + 1)
    for slot, value in rows.mapInArrow(run, "slot int, value double").groupBy("slot").sum("value").collect():
        total[slot] = value
    n = max(total[-1], 1.0)
    mean = total[:width] / n
    return mean, total[width:-1].reshape(width, width) / n - np.outer(mean, mean)


class Rotation:
    """Leading coordinates about a whole centre, and the length of the rest."""

    def __init__(self, mean, covariance, lead):
        self.centre = np.floor(mean)
        scale = np.abs(covariance).max()
        sound = np.isfinite(scale) and scale > 0
        values, basis = np.linalg.eigh(covariance / scale if sound else np.eye(len(mean)))
        self.basis = basis[:, np.argsort(-values)[:lead]]

    def __call__(self, x):
        d = x - self.centre
        near = d @ self.basis
        rest = d - near @ self.basis.T
        return near, np.sqrt((rest * rest).sum(1))


def squared(x, c):
    """Exact squared distances of the rows of x to c."""
    d = x - c
    return (d * d).sum(1)


def nearest(x, near, rest, centroids, rotation):
    """(cluster, distance, number of exact measurements) for the rows of x; ties to the
    smaller number. The centroids are lists of integers."""
    table = np.array(centroids, object)
    doubles = table.astype(np.float64)
    c_near, c_rest = rotation(doubles)
    x = whole(x)
    table = whole(doubles) if x.dtype == np.int64 else table
    if table.dtype != np.int64:
        x, table = x.astype(object), table.astype(object)
    length = (near * near).sum(1) + rest * rest
    bound = np.empty((len(x), len(table)))
    for j in range(len(table)):
        d = near - c_near[j]
        bound[:, j] = (d * d).sum(1) + (rest - c_rest[j]) ** 2 - SLACK * (length + c_near[j] @ c_near[j] + c_rest[j] ** 2)
    if x.dtype != np.int64:  # doubles may not tell these apart: all are measured
        bound[:] = -np.inf
    cluster = bound.argmin(1)
    distance = squared(x, table[cluster])
    measured = len(x)
    for j in range(len(table)):
        rows = np.flatnonzero((bound[:, j] <= distance.astype(np.float64)) & (cluster != j))
        if len(rows):
            measured += len(rows)
            d = squared(x[rows], table[j])
            better = (d < distance[rows]) | ((d == distance[rows]) & (j < cluster[rows]))
            distance[rows[better]], cluster[rows[better]] = d[better], j
    return cluster, distance, measured


def _rotated(rows, rotation, width):
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x array<double>, near array<double>, rest double"

    def run(batches):
        for b in pieces(batches):
            near, rest = rotation(matrix(b.column(1), width))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), list_column(near), pa.array(rest)],
                                             names=["vec_id", "x", "near", "rest"])

    return rows.mapInArrow(run, schema)


def _assigned(batches, centroids, rotation, width):
    lead = rotation.basis.shape[1]
    for b in pieces(batches):
        x = matrix(b.column("x"), width)
        near, rest = matrix(b.column("near"), lead), b.column("rest").to_numpy()
        yield (b, x, *nearest(x, near, rest, centroids, rotation))


def _means(table, centroids, rotation, width):
    """The centroids after one round; an empty one stays as it is."""
    k = len(centroids)

    def run(batches):
        sums, counts = [[0] * width for _ in range(k)], [0] * k
        for _, x, cluster, _, _ in _assigned(batches, centroids, rotation, width):
            x = whole(x)
            for j in range(k):
                rows = x[cluster == j]
                counts[j] += len(rows)
                sums[j] = [s + int(v) for s, v in zip(sums[j], rows.sum(0))] if len(rows) else sums[j]
        yield limbs([v for row in sums for v in row] + counts)

    total = summed(table.mapInArrow(run, LIMBS), k * (width + 1))
    counts = total[k * width:]
    return [[v // counts[j] for v in total[j * width:(j + 1) * width]] if counts[j] else list(centroids[j]) for j in range(k)]


def cluster(vectors, k=8, rounds=10, scale=1024, width=64, lead=16, salt="3:"):
    """`vec_id`, `cluster`, `distance` (squared), `cluster_inertia`, `inertia` and
    `centroid_sha256` for every vector with exactly `width` components, none null or
    non-finite; other rows take no part.

    Components are floor(scale * x) as exact integers of any size. The centroids start as the
    k vectors whose sha256 of `salt` and vec_id is smallest (a null vec_id counts as empty text;
    equal ids in the order of their components; equal rows count as often as they stand there).
    Fewer vectors give fewer centroids. Ties go to the smaller number, an empty centroid
    stays. Distances beyond 64 bits count as the nearest long. An empty table gives an empty
    one. Only `vec_id` and `embedding` are read, other columns may have any name.

    The vectors are read twice, written once with their rotated coordinates, and that table is
    scanned in every round; a round brings k * (width + 1) totals to the driver. Rounds that
    would change nothing are left out.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, width, float(scale))
    kind = rows.schema["vec_id"].dataType.simpleString()
    if is_empty(rows):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    rotation = Rotation(*moments(rows, width), min(lead, width))
    table = stored(_rotated(rows, rotation, width), "rotated")
    first = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [[int(v) for v in r["x"]] for r in table.select(first.alias("h"), "x").orderBy("h", "x").limit(k).collect()]
    for _ in range(rounds):
        before, centroids = centroids, _means(table, centroids, rotation, width)
        if centroids == before:
            break
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches):
        for b, _, at, distance, _ in _assigned(batches, centroids, rotation, width):
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(as_long(distance))],
                                             names=["vec_id", "cluster", "distance"])

    out = stored(table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    each = dict(out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # k rows
    cap = lambda v: min(int(v), (1 << 63) - 1)
    totals = spark.createDataFrame(
        [(j, cap(v), cap(sum(each.values())), digests[j]) for j, v in each.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
