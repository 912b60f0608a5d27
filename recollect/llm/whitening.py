"""Whitening of embeddings by the polarisation identity.

Only squares are aggregated: the exact sums of squared centred values of every dimension and of
the sum of every pair of dimensions. The variance of a sum less the two variances is twice the
covariance, so these differences give all cross-covariances, as exact integers, which are then
divided once and decomposed.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm.vectors import LIMBS, as_long, finite, limbs, padded, summed, whole

ROWS = 2048
SAFE = 2.0 ** 24  # below it, the squares of pair sums of so many rows fit 64 bits
LEAST = 1e-11  # share of the largest eigenvalue up to which one counts as zero


def _whole(batches, width, scale, shift):
    """(batch, rows, matrix) of the whole vectors x = floor(scale * c) + shift, as doubles."""
    for b in batches:
        for start in range(0, b.num_rows, ROWS):
            part = b.slice(start, ROWS)
            rows, sizes, flat = finite(part.column(1))
            yield part, rows, np.floor(scale * padded(sizes, flat, width)) + shift


def _centred(x, centre):
    """Exact whole numbers x - centre."""
    return whole(x - centre, SAFE) if np.abs(x).max(initial=0.0) < 2.0 ** 52 else \
        np.array([[int(v) - int(c) for v, c in zip(row, centre)] for row in x], object).reshape(x.shape)


def _squares(z):
    """Sums of the squares of every column, then of the sum of every pair of columns (i < j)."""
    out = [(z * z).sum(0)]
    for i in range(z.shape[1] - 1):
        pair = z[:, i:i + 1] + z[:, i + 1:]
        out.append((pair * pair).sum(0))
    return [int(v) for part in out for v in part]


def _sums(vectors, width, scale, shift):
    """The number of vectors and the exact sum of every dimension."""
    def run(batches):
        total = [0] * (width + 1)
        for _, rows, x in _whole(batches, width, scale, shift):
            if len(rows):
                z = whole(x, 2.0 ** 50)
                total = [t + int(v) for t, v in zip(total, [len(rows), *z.sum(0)])]
        yield limbs(total)

    total = summed(vectors.mapInArrow(run, LIMBS), width + 1)
    return total[0], total[1:]


def covariance(n, sums, centre, plain, pairs):
    """The covariance matrix, every entry rounded once.

    plain, pairs: sums of squares about whole centres; n * sum(z^2) - (sum z)^2 is n times the sum
    of squares about the mean, exactly.
    """
    width = len(sums)
    off = [s - n * c for s, c in zip(sums, centre)]
    own = [n * q - o * o for q, o in zip(plain, off)]
    out = np.zeros((width, width))
    at = 0
    for i in range(width):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, width):
            both = n * pairs[at] - (off[i] + off[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n * n)
            at += 1
    return out


class Whitening:
    """A fit: `n`, `sums`, the whole `centre`, `values` (falling) and `basis` of the covariance,
    and the share `explained` by every component."""

    def __init__(self, n, sums, centre, matrix):
        self.n, self.sums, self.centre = n, sums, centre
        values, basis = np.linalg.eigh(matrix)
        order = np.argsort(-values, kind="stable")
        values, basis = values[order], basis[:, order]
        lead = np.abs(basis).argmax(0)
        basis = basis * np.where(basis[lead, np.arange(basis.shape[1])] < 0, -1.0, 1.0)
        sound = values > max(values.max(initial=0.0), 0.0) * LEAST
        self.values, self.basis = values[sound], basis[:, sound]
        trace = float(np.trace(matrix))
        self.explained = self.values / trace if trace > 0 else self.values
        self.rest = np.array([(s - n * c) / n for s, c in zip(sums, centre)])

    def coordinates(self, z, top):
        return (z.astype(np.float64) - self.rest) @ (self.basis[:, :top] / np.sqrt(self.values[:top]))

    def deviation(self, z):
        """Sum over dimensions of (n * x - sum)^2, exact."""
        off = [s - self.n * c for s, c in zip(self.sums, self.centre)]
        reach = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, off), default=0)
        if reach * reach * max(len(off), 1) < 1 << 62:
            y = z * np.int64(self.n) - np.array(off, np.int64)
            return (y * y).sum(1)
        y = z.astype(object) * self.n - np.array(off, object)
        return (y * y).sum(1)


def fit(vectors, width, scale, shift):
    """The Whitening of `vectors` (id, embedding array<double>), or None where there is none."""
    n, sums = _sums(vectors, width, scale, shift)
    if not n:
        return None
    centre = [s // n for s in sums]

    def run(batches):
        total = [0] * (width * (width + 1) // 2)
        for _, rows, x in _whole(batches, width, scale, shift):
            if len(rows):
                total = [t + v for t, v in zip(total, _squares(_centred(x, np.array(centre, np.float64))))]
        yield limbs(total)

    total = summed(vectors.mapInArrow(run, LIMBS), width * (width + 1) // 2)
    return Whitening(n, sums, centre, covariance(n, sums, centre, total[:width], total[width:]))


def _identity_error(vectors, made, width, scale, shift, top):
    """Largest absolute entry of the covariance of the whitened vectors less the identity,
    measured over all of them."""
    centre = np.array(made.centre, np.float64)

    def run(batches):
        total = np.zeros(top * (top + 1))
        for _, rows, x in _whole(batches, width, scale, shift):
            w = made.coordinates(_centred(x, centre), top)
            total += np.concatenate((w.sum(0), (w.T @ w).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                         names=["slot", "value"])

    total = np.zeros(top * (top + 1))
    for slot, value in vectors.mapInArrow(run, "slot int, value double").groupBy("slot").sum("value").collect():
        total[slot] = value / made.n
    mean, second = total[:top], total[top:].reshape(top, top)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(top)).max())


def whiten(vectors, components=32, scale=64, shift=1_000_000):
    """`vec_id`, `component` (from 1), `n`, `deviation`, `whitened`, `explained`,
    `identity_error`: a row for each vector and leading principal component.

    Vectors that are null or hold a null, a NaN or an infinity take no part; a null vec_id
    stays null, repeated rows count as often as they occur. Vectors of different lengths:
    missing components are zero (before the shift). Components whose eigenvalue is at most
    1e-11 of the largest have no variance to divide by and are left out, so one vector, or
    equal ones, give no rows; so does an empty table. A deviation beyond 64 bits counts as the
    nearest long. The sign of a component is that which makes its largest entry positive.
    Only `vec_id` and `embedding` are read, other columns may have any name.

    Four scans of the vectors and no shuffle of them: sums, squares, the check of the result,
    the result. What reaches the driver is bounded by the square of the width.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    scale = float(scale)
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    made = fit(rows, width, scale, shift) if width > 0 else None
    top = min(components, len(made.values)) if made else 0
    if not top:
        return vectors.sparkSession.createDataFrame([], schema)
    error = _identity_error(rows, made, width, scale, shift, top)
    centre = np.array(made.centre, np.float64)

    def run(batches):
        for part, at, x in _whole(batches, width, scale, shift):
            z = _centred(x, centre)
            m = len(at)
            ids = part.column(0).take(pa.array(np.repeat(at, top)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), m)), pa.array(np.full(m * top, made.n, np.int64)),
                 pa.array(np.repeat(as_long(made.deviation(z)), top)), pa.array(made.coordinates(z, top).ravel()),
                 pa.array(np.tile(made.explained[:top], m)), pa.array(np.full(m * top, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
