"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (what stands between newlines) is hashed to a wide vector, and a text's fingerprint
is the sum of the vectors of its paragraphs, lane by lane modulo a power of two. The order of
paragraphs does not matter, and adding or subtracting a paragraph's vector inserts or deletes it.

The vector has two parts. 8 lanes modulo 2**64 are a digest of the whole paragraph and decide
equality. 256 lanes modulo 2**24 count the paragraph's grams of 16 bytes: a gram's hash chooses
one lane and a sign (a shorter paragraph is one gram). As the sums are linear, the inner product
of two such parts estimates how many grams two texts share, and
2 <a, b> / (<a, a> + <b, b>) is their likeness.
"""

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recollect.llm.common import in_parts, is_empty

EXACT, LANES, GRAM = 8, 256, 16
MODULUS = 1 << 24
BLOCK = 1 << 18  # bytes hashed at once
CHARS = 1 << 20  # characters fingerprinted at once, if texts are that short
_STEPS = [pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64) for i in range(4)]


def _mixed(h):
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _grams(raw):
    """Hashes of the GRAM bytes from every place on: each step doubles the length."""
    h = raw.astype(np.uint64) + np.uint64(1)
    for i, p in enumerate(_STEPS):
        h = h[:-(1 << i)] * np.uint64(p) + h[1 << i:]
    return _mixed(h)


def _count(near, doc, h):
    lane = (h & np.uint64(LANES - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    near += np.bincount(doc * LANES + lane, weights=sign, minlength=near.size).astype(np.int64)


def sums(texts):
    """(exact, near): one row of lane sums for each text."""
    n = len(texts)
    exact, near = np.zeros((n, EXACT), np.uint64), np.zeros(n * LANES, np.int64)
    coded = [t.encode("utf-8") for t in texts]
    parts = [c.split(b"\n") for c in coded]
    digests = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8 * EXACT).digest() for ps in parts for p in ps),
                            "<u8").reshape(-1, EXACT)
    sizes = np.array([len(ps) for ps in parts], np.int64)
    if n:
        exact[:] = np.add.reduceat(digests, np.cumsum(sizes) - sizes, axis=0)
    short = [(d, p) for d, ps in enumerate(parts) for p in ps if 0 < len(p) < GRAM]
    if short:
        h = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=8).digest() for _, p in short), "<u8")
        _count(near, np.array([d for d, _ in short], np.int64), h)
    raw = np.frombuffer(b"\n".join(coded), np.uint8)
    ends = np.cumsum([len(c) + 1 for c in coded])  # a newline after every text but the last
    for start in range(0, len(raw) - GRAM + 1, BLOCK):
        block = raw[start:start + BLOCK + GRAM - 1]
        breaks = np.concatenate(([0], np.cumsum(block == 10)))
        at = np.flatnonzero(breaks[GRAM:] == breaks[:-GRAM])
        _count(near, np.searchsorted(ends, at + start, "right"), _grams(block)[at])
    return exact, near.reshape(n, LANES)


def write(exact, near):
    """Fingerprints as strings (base64 of the lanes in order, little-endian)."""
    left = exact.astype("<u8").view(np.uint8).reshape(len(exact), -1)
    right = (near % MODULUS).astype("<u4").view(np.uint8).reshape(len(near), LANES, 4)[:, :, :3].reshape(len(near), -1)
    return [base64.b64encode(row.tobytes()).decode() for row in np.hstack((left, right))]


def read(fingerprints):
    """(exact, near) of fingerprint strings; near lanes are signed."""
    n = len(fingerprints)
    raw = np.frombuffer(b"".join(map(base64.b64decode, fingerprints)), np.uint8).reshape(n, -1)
    exact = np.ascontiguousarray(raw[:, :8 * EXACT]).view("<u8").astype(np.uint64)
    near = np.zeros((n, LANES, 4), np.uint8)
    near[:, :, :3] = raw[:, 8 * EXACT:].reshape(n, LANES, 3)
    return exact, signed(near.reshape(n, -1).view("<u4").astype(np.int64))


def signed(near):
    return (near + MODULUS // 2) % MODULUS - MODULUS // 2


def likeness(a, b):
    """0 to 1 for rows of near lanes; 1 where both are zero."""
    a, b = signed(a).astype(np.float64), signed(b).astype(np.float64)
    both, each = (a * b).sum(1), (a * a).sum(1) + (b * b).sum(1)
    return np.where(each > 0, np.clip(2 * both / np.maximum(each, 1), 0.0, 1.0), 1.0)


def edited(text, after):
    """The text whose last floor(n / 2) characters are replaced by the first as many (or all)
    of the one after it."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


# --- fingerprints of a table, and their upkeep --------------------------------------

def fingerprints(docs, key="doc_id", text="text"):
    """`key`, `fingerprint` of every row; a null text counts as empty."""
    def run(batches):
        for b in in_parts(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for start, stop in _runs([len(t) for t in texts]):
                made = write(*sums(texts[start:stop]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, stop - start), pa.array(made)], names=["key", "fingerprint"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def _runs(sizes):
    """Consecutive ranges of about CHARS characters at most."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > CHARS:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def update(table, edits, key="doc_id"):
    """Fingerprints after insertions and deletions of paragraphs, without the texts.

    edits: `key`, `paragraph` (one line), `change` (+1 inserted, -1 deleted, any whole number).
    Every task sums the vectors of its share by key, the lanes are added by Spark, so a key with
    very many edits is no large group. An edit of a key that the table lacks is left out; null
    paragraphs and changes count as nothing.
    """
    kind = table.select(key).schema[0].dataType.simpleString()
    width = EXACT + LANES

    def partial(batches):
        for b in in_parts(batches):
            keys = b.column(0).dictionary_encode()
            at = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            names = pa.concat_arrays([keys.dictionary, pa.nulls(1, keys.dictionary.type)])
            change = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            lanes = np.zeros((len(names), width), np.uint64)
            lines = b.column(1).to_pylist()
            for start, stop in _runs([len(p) for p in lines]):
                exact, near = sums(lines[start:stop])
                with np.errstate(over="ignore"):
                    vectors = np.hstack((exact, near.astype(np.uint64))) * change[start:stop].astype(np.uint64)[:, None]
                    np.add.at(lanes, at[start:stop], vectors)
            used = np.unique(at)
            # Halves of 32 bits: their sums over all tasks stay far from 64 bits.
            for half in (0, 1):
                part = (lanes[used] >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.repeat(used, width))),
                     pa.array(np.tile(np.arange(width, dtype=np.int32) + half * width, len(used))),
                     pa.array(part.ravel().astype(np.int64))], names=["key", "lane", "part"])

    def applied(batches):
        for b in in_parts(batches):
            exact, near = read(b.column(1).to_pylist())
            parts = [p or [0] * (2 * width) for p in b.column(2).to_pylist()]
            p = np.array(parts, np.int64).reshape(-1, 2, width).astype(np.uint64)
            with np.errstate(over="ignore"):
                lanes = p[:, 0] + (p[:, 1] << np.uint64(32))
                made = write(exact + lanes[:, :EXACT], near + (lanes[:, EXACT:] % np.uint64(MODULUS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], names=["key", "fingerprint"])

    sound = edits.where("paragraph is not null and change is not null").select(
        F.col(key).alias("key"), "paragraph", F.col("change").cast("long").alias("change"))
    lanes = sound.mapInArrow(partial, f"key {kind}, lane int, part long").groupBy("key", "lane").agg(F.sum("part").alias("part"))
    each = lanes.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "part"))),
                                                lambda r: r["part"]).alias("parts"))  # 2 * 264 entries
    rows = table.select(F.col(key).alias("key"), "fingerprint").alias("t")
    return rows.join(each.alias("e"), F.col("t.key").eqNullSafe(F.col("e.key")), "left").select(
        "t.key", "fingerprint", "parts").mapInArrow(applied, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


# --- the edited texts ------------------------------------------------------------------

def _buckets(keys, n):
    """Borders that cut the ordered keys into about n ranges, from a sample of about 100 keys for
    each. The sample only decides how even the ranges are."""
    rows = keys.count()
    n = max(1, min(n, -(-rows // 50)))
    share = min(1.0, 100 * n / max(rows, 1))
    found = keys if share == 1.0 else keys.sample(share, seed=7)
    ordered = sorted(_key(*r) for r in found.collect())  # about 100 keys a range
    return [ordered[i * len(ordered) // n] for i in range(1, n)] if ordered else []


def _key(doc_id, h, place):
    return (doc_id is not None, doc_id if doc_id is not None else 0, h, place)


def edited_fingerprints(docs):
    """Per row: `doc_id`, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`,
    `near_edited`, `near_next`.

    The edited text takes its second half from the next row in descending order of doc_id (nulls
    last; equal ids by descending hash of the text, equal texts in any order, which changes
    nothing); after the last row comes the first. A null text counts as empty; the likeness of
    two texts without any gram is 1. A single row is its own next. An empty table gives an empty
    one. Only `doc_id` and `text` are read, other columns may have any name.

    Rows are dealt by range of their key, so every text is shuffled once; equal rows are told
    apart by their place, so that very many of them are dealt to several ranges. The last row of
    a range goes to the following range as well, where it is the neighbour of the first row. Each
    task walks its rows in order, holding about a million characters.
    """
    spark = docs.sparkSession
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    out = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
                        F.monotonically_increasing_id().alias("place"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if is_empty(docs):
        return spark.createDataFrame([], out)
    keys = keyed.select("doc_id", "h", "place")
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = _buckets(keys, wanted)
    n = len(borders) + 1

    def greatest(batches):
        best = {}
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                k = _key(*r)
                at = bisect_left(borders, k)
                if at not in best or best[at] < k:
                    best[at] = k
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.int32()), pa.array([k[1] if k[0] else None for k in best.values()], id_type),
             pa.array([k[2] for k in best.values()], pa.int64()), pa.array([k[3] for k in best.values()], pa.int64())],
            names=["bucket", "doc_id", "h", "place"])

    tops = keys.mapInArrow(greatest, f"bucket int, doc_id {kind}, h long, place long").groupBy("bucket").agg(
        F.max(F.struct("doc_id", "h", "place")).alias("k")).collect()  # a row for each range
    used = sorted(r["bucket"] for r in tops)
    follower = dict(zip(used, used[1:] + used[:1]))  # the first row's neighbour is the last row
    last = {_key(*r["k"]): follower[r["bucket"]] for r in tops}

    def deal(batches):
        for b in batches:
            found = [_key(*r) for r in zip(*(c.to_pylist() for c in b.columns[:3]))]
            at = [bisect_left(borders, k) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([1] * len(at), pa.int32()), *b.columns],
                                             names=["bucket", "own", *b.schema.names])
            for i, k in enumerate(found):
                if k in last:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([last[k]], pa.int32()), pa.array([0], pa.int32()), *b.slice(i, 1).columns],
                        names=["bucket", "own", *b.schema.names])

    def solve(ids, texts, before):
        """Rows of texts[i] whose next text is before[i]."""
        changed = [edited(t, p) for t, p in zip(texts, before)]
        e1, n1 = sums(texts + [before[0]])
        nexts = np.vstack((n1[-1:], n1[:-2]))
        e2, n2 = sums(changed)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(c.encode("utf-8")).hexdigest() for c in changed]), pa.array(write(e1[:-1], n1[:-1])),
             pa.array(write(e2, n2)), pa.array(likeness(n1[:-1], n2)), pa.array(likeness(n1[:-1], nexts))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def walk(batches):
        ids, texts, before, chars, previous = [], [], [], 0, None
        for b in in_parts(batches):
            for own, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("own", "doc_id", "text"))):
                if texts and (not own or chars + len(text) > CHARS):
                    yield solve(ids, texts, before)
                    ids, texts, before, chars = [], [], [], 0
                if own:
                    ids.append(doc_id)
                    texts.append(text)
                    before.append(previous)
                    chars += len(text)
                previous = text
        if texts:
            yield solve(ids, texts, before)

    dealt = keyed.mapInArrow(deal, f"bucket int, own int, doc_id {kind}, h long, place long, text string")
    return dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "own", "doc_id", "h", "place").mapInArrow(walk, out)
