"""Vectors of Arrow batches as matrices of whole numbers."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SMALL = 2.0 ** 26  # below it, squared distances of 64 components and more fit 64 bits
LONG = (1 << 63) - 1


def finite(column):
    """(rows, lengths, flat): the places of the vectors of a list column that are neither null
    nor hold a null, a NaN or an infinity, their lengths, and their components in a row."""
    size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    odd = np.bincount(row[~np.isfinite(flat)], minlength=len(size))
    good = (size >= 0) & (odd == 0)
    return np.flatnonzero(good), size[good], flat[good[row]]


def padded(sizes, flat, width):
    """The vectors as the rows of one matrix; missing components are zero."""
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def whole(values, small=SMALL):
    """Whole numbers held by doubles: int64 where all are small, Python integers else."""
    if values.size == 0 or np.abs(values).max() < small:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def as_long(values):
    """int64; what lies beyond 64 bits counts as the nearest long."""
    return values if values.dtype == np.int64 else np.clip(values, -LONG - 1, LONG).astype(np.int64)


def list_column(matrix):
    """A matrix as an Arrow list column."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


LIMB = 32
LIMBS = "slot int, limb int, part long"


def limbs(values):
    """(slot, limb, part) of exact integers of any size: the value of a slot is the sum of
    part * 2**(32 * limb). Parts add up as longs, whatever the size of the values."""
    slot, limb, part = [], [], []
    for s, v in enumerate(values):
        rest, at = int(v), 0
        while rest:
            top = -(1 << 31) <= rest < 1 << 31
            slot.append(s)
            limb.append(at)
            part.append(rest if top else rest & 0xFFFFFFFF)
            rest, at = 0 if top else rest >> LIMB, at + 1
    return pa.RecordBatch.from_arrays(
        [pa.array(slot, pa.int32()), pa.array(limb, pa.int32()), pa.array(part, pa.int64())], names=["slot", "limb", "part"])


def summed(parts, slots):
    """The exact totals of the limbs that all tasks gave: a list of `slots` integers.
    What reaches the driver is a few rows for each slot."""
    total = [0] * slots
    for r in parts.groupBy("slot", "limb").sum("part").collect():
        total[r[0]] += r[2] << (LIMB * r[1])
    return total
