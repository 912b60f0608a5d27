"""Near copies by SimHash and BK-trees, confirmed by their word shingles.

Two texts are near copies when the sets of their five-word shingles have a Jaccard similarity of
0.8 or more. The SimHashes of such texts differ in some ten of 64 bits, far too many for blocks
of bits to agree, so shards are named by minimum hashes of the shingles instead: each of `keys`
hash orders names a text's smallest shingle, and two texts at 0.8 agree in a given order with
probability 0.8. A shard is one BK-tree over SimHashes, searched within `radius` bits, and
what it finds is confirmed by the shingles themselves.

Equal texts are one item. A shard above `shard_rows` items is cut into chunks, and every pair of
chunks is searched in a task of its own. A pair is confirmed only where no links connect it yet,
so a shard hands on a spanning forest, never all pairs of a group.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from recollect.llm.bktree import BKTree
from recollect.llm.common import discard, in_parts, release, stored, utf8
from recollect.llm.components import components

BITS = 64
BLOCK = 1 << 16
EMPTY = 0  # the shard key of texts without a word
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text, shingle=5, seed=42):
    """64-bit hashes of the text's word shingles, repeats included (fewer words: of all of them)."""
    words = utf8(text).lower().split()  # bytes: ASCII white space, A-Z
    if not words:
        return np.zeros(0, np.uint64)
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[width - 1:].tolist())), np.uint64, n)


def simhash(hashes):
    """A bit is set where over half of the hashes have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def smallest(hashes, keys):
    """The smallest hash in each of `keys` orders, as signed longs that tell the order too."""
    if not len(hashes):
        return [EMPTY]
    out = []
    for k in range(keys):
        mixed = (hashes ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & (1 << 64) - 1)) * _ODD
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD
        out.append(int(((mixed ^ (mixed >> np.uint64(29))).min() >> np.uint64(4)) << np.uint64(3)) | (k & 7))
    return out


def prints(docs, shingle, keys):
    """doc_id, text_hash, fp, keys, marks (the sorted distinct shingles, 32 bits each) per row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in in_parts(batches):
            found = [shingle_hashes(t.as_py(), shingle) for t in b.column(2)]
            marks = [np.unique((h >> np.uint64(32)).astype("<u4")).tobytes() for h in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(np.array([simhash(h) for h in found], np.uint64).view(np.int64)),
                 pa.array([smallest(h, keys) for h in found], pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "text_hash", "fp", "keys", "marks"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, f"doc_id {id_type}, text_hash bigint, fp bigint, keys array<bigint>, marks binary")


def similarity(a, b):
    """Jaccard similarity of two sorted sets; of two empty ones it is 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class Forest:
    """Which of n items are connected."""

    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[max(a, b)] = min(a, b)


def confirmed(fps, marks, left, right, radius, least):
    """Links (i, j) of a spanning forest of the confirmed pairs between the items of two chunks."""
    one, two = np.flatnonzero(left), np.flatnonzero(right)
    sets = [np.frombuffer(m, "<u4") for m in marks]
    size = np.array([len(s) for s in sets])
    forest = Forest(len(fps))
    tree = BKTree(fps[one])
    for start in range(0, len(two), 256):  # bounds the pairs held at once
        hits = tree.within(fps[two[start:start + 256]], radius)
        a, b = two[start + hits[:, 0]], one[hits[:, 1]]
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        fits = (a != b) & (small >= least * large)
        for i, j in zip(a[fits].tolist(), b[fits].tolist()):
            x, y = forest.find(i), forest.find(j)
            if x != y and similarity(sets[i], sets[j]) >= least:
                forest.join(x, y)
                yield i, j


def _search(radius, least):
    """Links inside each shard, read as runs of equal (key, i, j)."""
    def run(batches):
        held, who = [], None

        def flush():
            part = pa.concat_batches(held) if len(held) > 1 else held[0]
            chunk, i, j, ids = (part.column(n).to_numpy() for n in ("chunk", "i", "j", "text_hash"))
            fps = part.column("fp").to_numpy().view(np.uint64)
            links = list(confirmed(fps, [m.as_py() for m in part.column("marks")], chunk == i, chunk == j, radius, least))
            return pa.RecordBatch.from_arrays([pa.array([int(ids[x]) for x, _ in links], pa.int64()),
                                               pa.array([int(ids[y]) for _, y in links], pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(n).to_numpy().astype(np.int64) for n in ("key", "i", "j")], 1)
            cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                now = tuple(keys[s])
                if held and now != who:
                    yield flush()
                    held.clear()
                who = now
                held.append(b.slice(s, e - s))
        if held:
            yield flush()

    return run


def links(rows, radius, least, shard_rows):
    """Links `a`, `b` (text hashes) that connect all near copies among the rows of `prints`."""
    narrow = rows.select("text_hash", F.explode("keys").alias("key")).distinct()
    sizes = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stored(narrow.join(sizes, "key"), "copy-shards")
    wanted = member.select("text_hash").distinct()
    items = rows.groupBy("text_hash").agg(F.first("fp").alias("fp"), F.first("marks").alias("marks")).join(
        wanted, "text_hash", "left_semi")
    member = member.join(items, "text_hash").withColumn("chunks", F.ceil(F.col("n") / shard_rows).cast("int"))
    member = member.withColumn("chunk", F.pmod(F.col("text_hash"), F.col("chunks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    dealt = member.select("key", "text_hash", "fp", "marks", "chunk", F.explode(others).alias("other")).select(
        "key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "text_hash", "fp", "marks")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "text_hash").mapInArrow(
        _search(radius, least), "a bigint, b bigint")


def keep_one_similar(docs, least=0.8, shingle=5, radius=18, keys=5, shard_rows=4096):
    """One row of docs for each group of near copies, with all its columns: that of the smallest
    doc_id, null last; of rows with that doc_id, the one with the smallest text hash.

    A group is what links of similarity `least` or more connect. A-Z are lower-cased, words are
    what ASCII white space separates; of fewer words than a shingle the whole sequence is one.
    Null, empty and blank texts are copies of each other. Equal rows stay once. An empty
    table gives an empty table. Columns of docs may have any name.

    Of pairs at exactly 0.8, some 0.03 % share no key and 0.2 % differ in more than 18 bits; links
    through other copies often connect them all the same.
    """
    rows = stored(prints(docs, shingle, keys), "word-prints")
    stars = components(links(rows, radius, least, shard_rows), "copy-stars")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = rows.groupBy("text_hash").agg(F.min(order).alias("k"))
    root = stars.select(F.col("a").alias("text_hash"), F.col("b").alias("root"))
    keepers = first.join(root, "text_hash", "left").groupBy(F.coalesce("root", "text_hash").alias("root")).agg(F.min("k").alias("k"))
    name = lambda c: [F.coalesce(c.cast("string"), F.lit("")).alias("id"), c.isNull().alias("none")]
    kept = stored(keepers.select(*name(F.col("k.doc_id")), F.col("k.text_hash").alias("text_hash")), "copy-keepers")
    discard(rows)  # the shingles need not lie beside what later stages write,
    release(docs.sparkSession)  # nor the shuffle files that dealt them out
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *name(F.col("doc_id")),
                      F.xxhash64("text").alias("text_hash"))
    at = ["id", "none", "text_hash"]  # one shuffle of the texts serves the join and the rows that occur twice
    return own.join(kept, at, "left_semi").dropDuplicates(at).select("row.*")
