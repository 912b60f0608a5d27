"""Content-chosen anchor suffixes of byte strings, in numpy.

Every window of `width` bytes holds `width - gram + 1` grams; the window's anchor
is the gram with the smallest mixed hash, the leftmost on ties. The choice hangs on
the window's bytes alone, so equal windows have equal anchors at equal offsets, and
windows need only be compared under their anchor. Consecutive windows with one
anchor form a run; about one run begins every (width - gram + 2) / 2 bytes.
"""

import numpy as np

SEGMENT = 1 << 18  # window starts handled at once; positions must fit PLACE bits
PLACE = 20
_MASK = np.uint64((1 << PLACE) - 1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS = {}


def _powers(base, n):
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * SEGMENT)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            out.append(np.multiply.accumulate(step))
        have = _POWERS[base] = tuple(out)
    return have


def _codes(salt):
    """A fixed random 64-bit code for each byte value."""
    return np.random.Generator(np.random.PCG64(salt)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


_CODES = (_codes(1), _codes(2))


def mix(x):
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any slice of a byte array from prefix sums."""

    def __init__(self, data, which=0):
        base = _BASE if which == 0 else _BASE ^ 0x5DEECE66D0
        self.power, self.inverse = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[which][data] * self.power[:len(data)], out=self.sums[1:])

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(x, w):
    """Smallest of each w consecutive values."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(x)] = x
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def runs(data, ends, width, gram):
    """Runs of windows with one anchor.

    data: bytes of some texts laid end to end; ends: where each text ends.
    Returns text index, first window start, last window start (both in `data`),
    leading key (the anchor's first three bytes, then 40 bits of its gram's hash), hash
    of all bytes the run's windows cover.
    """
    n = len(data)
    starts = n - width + 1
    if starts <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    one = Hashes(data)
    places = np.arange(n - gram + 1)
    gram_hash = one.of(places, places + gram)
    ranked = (gram_hash & ~_MASK) | places.astype(np.uint64)
    anchor = (sliding_min(ranked, width - gram + 1) & _MASK).astype(np.int64)
    text = np.searchsorted(ends, np.arange(starts), side="right")
    valid = np.arange(starts) + width <= ends[text]
    at = np.flatnonzero(valid)
    if not len(at):
        return runs(data[:0], ends, width, gram)
    chosen = anchor[at]
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(chosen) != 0) | (np.diff(text[at]) != 0))
    first = at[np.concatenate(([0], cut + 1))]
    last = at[np.concatenate((cut, [len(at) - 1]))]
    chosen = anchor[first]
    lead = gram_hash[chosen] >> np.uint64(24)
    for i, shift in enumerate((56, 48, 40)):
        lead |= data[chosen + i].astype(np.uint64) << np.uint64(shift)
    return text[first], first, last, lead, Hashes(data, 1).of(first, last + width)
