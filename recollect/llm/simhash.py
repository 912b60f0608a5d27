"""SimHash near-dedup with BK-trees.

A document's fingerprint has a bit set where over half of its word-shingle hashes
have it. Equal fingerprints are one item from there on, so a group of exact copies
costs one row per task.

Shard trees: two fingerprints at most `radius` bits apart agree in at least two of
radius + 2 bit blocks, so items are shuffled once for every pair of blocks, to the
shard that the values of the two blocks name, and each shard is one BK-tree. No tree
and no list of fingerprints is broadcast, since both grow with the documents: a query
goes to the only shards that can hold a partner. A shard above `shard_rows` items is
cut into chunks, and every pair of chunks is searched in a task of its own. A shard
hands on the links of a spanning forest, never all pairs of a group.
"""

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from recollect.llm.bktree import BKTree, forest
from recollect.llm.common import batch, in_parts, stored, utf8
from recollect.llm.components import components

BITS = 64


def fingerprint(text, shingle=3, seed=42):
    """Unsigned 64-bit SimHash of the text's word shingles; no word: zero."""
    words = utf8(text).lower().split()  # bytes: ASCII white space, A-Z
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    spans = zip(starts[:n].tolist(), ends[width - 1:].tolist())
    for at in range(0, n, 1 << 16):
        size = min(1 << 16, n - at)
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in _take(spans, size)), np.uint64, size)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _take(iterator, n):
    for _, x in zip(range(n), iterator):
        yield x


def fingerprints(docs, shingle=3):
    """`doc_id`, `text_hash`, `fp` (the fingerprint as a signed long) per row of docs."""
    import pyarrow as pa

    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in in_parts(batches):
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {id_type}, text_hash bigint, fp bigint")


def shard_keys(fp, radius):
    """The shards of a fingerprint: one for each pair of radius + 2 bit blocks."""
    blocks = radius + 2
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
            for lo, hi in zip(cuts, cuts[1:])]
    return F.array(*[
        F.shiftleft(F.lit(number).cast("long"), 56).bitwiseOR(F.shiftleft(part[i], 28)).bitwiseOR(part[j])
        for number, (i, j) in enumerate(combinations(range(blocks), 2))])


def _search(radius):
    """Links inside each shard, read as runs of equal (key, i, j)."""
    import pyarrow as pa

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(fps, left, right):
        if len(fps) < 2:
            return None
        one = np.flatnonzero(left)
        two = np.flatnonzero(right)
        hits = BKTree(fps[one]).within(fps[two], radius)
        root = forest(len(fps), np.stack([two[hits[:, 0]], one[hits[:, 1]]], 1))
        own = np.flatnonzero(root != np.arange(len(fps)))
        return fps[own], fps[root[own]]

    def run(batches):
        rest = None
        out = []

        def flush(rows):
            keys = np.stack([rows["key"], rows["i"], rows["j"]], 1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for s, e in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(keys)])).tolist()):
                if e - s > 1:
                    got = links(rows["fp"][s:e].view(np.uint64), rows["chunk"][s:e] == rows["i"][s:e],
                                rows["chunk"][s:e] == rows["j"][s:e])
                    if got and len(got[0]):
                        out.append(got)

        for b in batches:
            rows = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "i", "j", "chunk", "fp")}
            if rest is not None:
                rows = {n: np.concatenate((rest[n], v)) for n, v in rows.items()}
            if not len(rows["key"]):
                continue
            last = [rows[n] == rows[n][-1] for n in ("key", "i", "j")]
            cut = int(np.argmax(last[0] & last[1] & last[2]))
            rest = {n: v[cut:] for n, v in rows.items()}
            if cut:
                flush({n: v[:cut] for n, v in rows.items()})
            for x, y in out:
                yield batch(schema, x.view(np.int64), y.view(np.int64))
            out.clear()
        if rest is not None:
            flush(rest)
            for x, y in out:
                yield batch(schema, x.view(np.int64), y.view(np.int64))

    return run


def near_links(items, radius=3, shard_rows=4096):
    """items: distinct `fp`. Links `a`, `b` that connect all fingerprints at most
    `radius` bits apart (a spanning forest of each shard)."""
    keyed = items.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = keyed.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / shard_rows).cast("int"))
    member = member.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    member = member.select("key", "fp", "chunk", F.explode(others).alias("other")).select(
        "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp")
    return member.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(
        _search(radius), "a bigint, b bigint")


def near_groups(docs, radius=3, shingle=3):
    """`doc_id`, `text_hash`, `fp`, `component_id` per row of docs: the smallest doc_id
    that can be reached over links of at most `radius` differing bits; `root` names the
    component by one of its fingerprints.

    Null, empty and blank texts have fingerprint zero and are linked like any other.
    Fewer words than a shingle: the whole sequence is one shingle. Repeated rows share
    a component. Null doc_ids are never the smallest; a component of null doc_ids only
    has a null component_id. An empty table gives an empty table.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    items = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    stars = components(near_links(items.select("fp"), radius), "fingerprint-stars")
    linked = stars.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    linked = linked.unionByName(linked.select(F.col("root").alias("fp"), "root").distinct())
    smallest = linked.join(items, "fp").groupBy("root").agg(F.min("first").alias("least"))
    named = items.join(linked.join(smallest, "root").select("fp", "root", "least"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs, radius=3, shingle=3):
    """One row of docs for each component, with all its columns: that of the smallest
    doc_id, null last; of rows with that doc_id, the one with the smallest text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keepers = near_groups(docs, radius, shingle).groupBy("root").agg(F.min(order).alias("k")).select(
        F.col("k.doc_id").alias("doc_id"), F.col("k.text_hash").alias("text_hash"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("text_hash"))
    same = F.col("row.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    kept = rows.alias("d").join(keepers.alias("k"), same, "left_semi")
    return kept.withColumn("doc_id", F.col("row.doc_id")).dropDuplicates(["doc_id", "text_hash"]).select("row.*")
