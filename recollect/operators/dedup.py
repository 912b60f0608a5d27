"""Near-duplicate linking, frame hashing and gating, similarity caching."""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators.ordered import HOT_ROWS, Ordered
from recollect.session import written

GATE_ROWS = 200_000


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def cosine(a, b):
    """Cosine similarity in double; 0 when a norm is 0."""
    a, b = T.col(a), T.col(b)
    return T.let(F.struct(dot(a, b).alias("ab"), F.sqrt(dot(a, a)).alias("a"),
                          F.sqrt(dot(b, b)).alias("b")),
                 lambda x: F.when((x["a"] == 0) | (x["b"] == 0), F.lit(0.0))
                 .otherwise(x["ab"] / (x["a"] * x["b"])))


def mark_links(memory, threshold=rules.LINK_SIMILARITY, limit=HOT_ROWS):
    """Add `fact` (the seq of the row that began the fact) and `linked`.

    A row extends the one before it in its stream when app and title are equal
    and the vectors are similar enough; the vectors are compared only then."""
    o = Ordered(memory, ["stream"], ["time_start", "seq"], C.micros("time_start"), limit)
    o.previous(["app_name", "window_title", "embedding"], "_prev")
    same = ((F.col("_prev.app_name") == F.col("app_name"))
            & (F.col("_prev.window_title") == F.col("window_title")))
    linked = F.when(same, cosine("_prev.embedding", "embedding") >= threshold).otherwise(False)
    o.df = o.df.withColumn("linked", F.coalesce(linked, F.lit(False))).drop("_prev")
    o.last_known([("fact", F.when(~F.col("linked"), F.col("seq")))])
    return o.result()


def chronos_facts(marked, details=None):
    """One row per fact.  Later texts stay rows of `chronos_deltas`: a fact
    may be extended any number of times, so an array would have no bound.

    A fact's text is that of its first row, whose seq names the fact. details: adds
    texts to rows with a seq; linking then needs no texts, only keys, titles and vectors."""
    at = F.struct("time_start", "seq")
    text = [] if details else [F.min_by("text", at).alias("text")]
    facts = marked.groupBy("stream", "fact").agg(
        F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        F.first("app_name").alias("app_name"), F.first("window_title").alias("window_title"),
        *text, F.max_by("embedding", at).alias("embedding"), (F.count(F.lit(1)) - 1).alias("deltas"))
    return details(facts.withColumn("seq", F.col("fact"))).drop("seq") if details else facts


def chronos_deltas(marked, details=None):
    """The later texts of each fact as rows."""
    later = marked.filter("linked")
    return (details(later) if details else later).select("stream", "fact", C.micros("time_start").alias("t"), "text")


def stability_rate(marked):
    """D3."""
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count_if("linked").alias("linked"),
                      F.round(F.avg(F.col("linked").cast("double")) * 100, 6).alias("stability_pct"))


def average_hash(cells):
    """Bit i is set when cell i lies above the integer mean."""
    cells = T.col(cells)
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda s, x: s + x)
    return T.let(C.div(total, F.size(cells).cast("long")), lambda mean: F.aggregate(
        F.transform(cells, lambda x, i: F.when(
            x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i))
            .otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda h, b: h.bitwiseOR(b)))


def hash_frames(frames, side=4):
    """Frames with their whole hash and one hash per block of cells."""
    step = F.lit(64 // side)
    parts = F.transform(F.sequence(F.lit(0), F.lit(side - 1)),
                        lambda b: average_hash(F.slice("cells", b * step + 1, step)))
    return frames.select("stream", "time_start", "seq", "app_name",
                         average_hash("cells").alias("phash"), parts.alias("blocks"))


def block_hashes(pixels, bits=64):
    """Per block, the hash of its first 64 pixels against the block mean."""
    head = F.collect_list(F.when(F.col("pos") < bits, F.struct("pos", "value")))
    g = pixels.groupBy("frame", "block").agg(
        F.sum("value").alias("_sum"), F.count(F.lit(1)).alias("_n"), head.alias("_head"))
    mean = C.div(F.col("_sum"), F.col("_n"))
    h = F.aggregate("_head", F.lit(0).cast("long"), lambda acc, p: F.when(
        p["value"] > mean, acc.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), p["pos"].cast("int")))).otherwise(acc))
    return g.select("frame", "block", h.alias("hash"))


def hamming(a, b):
    return F.bit_count(T.col(a).bitwiseXOR(T.col(b)))


def changed_block_ratio(hashes):
    """Share of blocks that differ by more than 5 bits from the frame before."""
    prev = hashes.select((F.col("frame") + 1).alias("frame"), "block", F.col("hash").alias("_prev"))
    return hashes.join(prev, ["frame", "block"]).groupBy("frame").agg(
        F.round(F.avg((hamming("hash", "_prev") > rules.BLOCK_CHANGED_BITS).cast("double")), 6)
        .alias("ratio"))


def hash_threshold(app):
    """Fewer bits make a change for code editors."""
    return F.when(K.is_code_editor(app), rules.TIGHT_HASH_BITS).otherwise(rules.LOOSE_HASH_BITS)


def hamming_near_dups(hashed, limit=HOT_ROWS):
    """Frames nearer to the frame before them than the app's threshold."""
    o = Ordered(hashed, ["stream"], ["time_start", "seq"], C.micros("time_start"), limit)
    o.previous(["phash"], "_prev")
    return o.result().withColumn("near", F.coalesce(
        hamming("phash", "_prev.phash") < hash_threshold("app_name"), F.lit(False))).drop("_prev")


def accepts(phash, cur, need, last, blocks):
    """Whether a frame differs enough from the last kept one (a row helper)."""
    def bits(a, b):
        return ((a ^ b) & (2 ** 64 - 1)).bit_count()

    if any(blocks):
        changed = sum(bits(a, b) > rules.BLOCK_CHANGED_BITS for a, b in zip(blocks, cur))
        if changed / len(cur) < rules.DIRTY_RATIO_MIN:
            return False
    return bits(phash, last) >= need


GATED = ["stream", "_seg", "time_start", "seq", "phash", "blocks"]
GATE_SCHEMA = ("stream bigint, _seg int, time_start timestamp_ntz, seq bigint, phash bigint, "
               "blocks array<bigint>, accepted boolean")


def _gate_sorted(batches):
    """Walk sorted rows batch by batch; only the last kept frame is held."""
    who, last, blocks = None, 0, []
    for b in batches:
        rows = zip(*(b.column(n).to_pylist() for n in (
            "stream", "_seg", "phash", "blocks", "need", "start_phash", "start_blocks")))
        flags = []
        for stream, seg, phash, cur, need, start, start_blocks in rows:
            if (stream, seg) != who:
                who, last, blocks = (stream, seg), start, start_blocks
            ok = accepts(phash, cur, need, last, blocks)
            if ok:
                last, blocks = phash, cur
            flags.append(ok)
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in GATED), pa.array(flags)],
                                         [*GATED, "accepted"])


def frame_gate(hashed, limit=GATE_ROWS):
    """Keep a frame only when it differs enough from the last kept frame.

    Each row depends on the rows before it, so a stream is sequential.  A stream
    longer than `limit` is cut into segments that run at the same time from an
    assumed start; segments whose true start turns out different run again.
    Two runs agree from the first frame both accept, so few rounds are needed,
    and the result is exact."""
    o = Ordered(hashed.withColumn("need", hash_threshold("app_name")), ["stream"],
                ["time_start", "seq"], C.micros("time_start"), limit)
    none = F.array().cast("array<bigint>")
    frames = o.df if o.hot else o.df.withColumn("_seg", F.lit(0))
    key = ["stream", "_seg"]

    def run(rows):
        cols = [*GATED, "need", "start_phash", "start_blocks"]
        return (rows.select(*cols).repartition(*o.parts).sortWithinPartitions(*key, "time_start", "seq")
                .mapInArrow(_gate_sorted, GATE_SCHEMA))

    cold = frames.withColumns({"start_phash": F.lit(0).cast("long"), "start_blocks": none})
    if not o.hot:
        return run(cold).drop("_seg")
    done = written(run(cold), "gate")
    starts = done.select(*key).distinct().withColumns({"p": F.lit(0).cast("long"), "b": none})
    while True:
        ends = done.groupBy(*key).agg(F.max_by(
            F.when(F.col("accepted"), F.struct("phash", "blocks")),
            F.when(F.col("accepted"), F.struct("time_start", "seq"))).alias("_end"))
        w = Window.partitionBy("stream").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
        came = ends.withColumn("_in", F.last("_end", ignorenulls=True).over(w)).select(
            *key, F.coalesce("_in.phash", F.lit(0).cast("long")).alias("p"),
            F.coalesce("_in.blocks", none).alias("b"))
        came = written(came, "gate-starts")
        changed = came.exceptAll(starts)   # at most one row per segment
        if changed.isEmpty():
            return done.drop("_seg")
        again = run(frames.join(F.broadcast(changed), key).withColumnsRenamed(
            {"p": "start_phash", "b": "start_blocks"}))
        done = written(done.join(F.broadcast(changed.select(*key)), key, "left_anti")
                       .unionByName(again), "gate")
        starts = came


def cached_hit(cache, now, words, ttl_us, threshold):
    """The live entries (id, time, words) of a cache and the oldest one that is
    similar enough to a question's word set, with the similarity (a row helper)."""
    live = [e for e in cache if now - e[1] < ttl_us]
    for e in live:
        both = len(words & e[2])
        if both and both >= threshold * (len(words) + len(e[2]) - both):
            return live, e, both / (len(words) + len(e[2]) - both)
    return live, None, 0.0


def _walk_cache(ttl_us, threshold, entries):
    def run(batches):
        who, cache = None, []
        for b in batches:
            out = []
            for key, seg, query, now, words in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (key, seg) != who:
                    who, cache = (key, seg), []
                words = frozenset(words)
                cache, hit, score = cached_hit(cache, now, words, ttl_us, threshold)
                if hit:
                    out.append((query, hit[0], round(score, 6)))
                else:
                    cache = [*cache, (query, now, words)][-entries:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                names=["query_id", "hit_id", "similarity"])
    return run


def jaccard_cache_join(queries, key, ttl_s=300, threshold=0.85, entries=20, limit=HOT_ROWS):
    """For each question the oldest cached one younger than the TTL and similar
    enough. A cache holds the last `entries` questions that were not served from it.

    A pause of the TTL empties a cache, so every key is cut there; the pieces are
    walked in order, batch by batch, and only the cache is held."""
    ttl = ttl_s * 1_000_000
    o = Ordered(queries.withColumn("_us", C.micros("ts")), [key], ["_us", "query_id"], F.col("_us"), limit)
    o.previous(["_us"], "_prev")
    paused = F.coalesce(F.col("_us") - F.col("_prev._us") >= ttl, F.lit(False))
    o.running_sum(F.when(paused, 1).otherwise(0), "_run")
    rows = o.result().select(F.col(key).alias("_key"), "_run", "query_id", "_us", T.word_set("text").alias("_words"))
    return (rows.repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_us", "query_id")
            .mapInArrow(_walk_cache(ttl, threshold, entries), "query_id bigint, hit_id bigint, similarity double"))


def embed_once(rows, text, embed, limit=HOT_ROWS):
    """(seq, embedding) with each distinct text embedded once.

    Only one copy of a text is shuffled; rows travel as their text's digest.  A
    text with very many copies is salted, so that no task receives them all."""
    keyed = rows.withColumn("_digest", F.sha2(text, 256))
    once = keyed.groupBy("_digest").agg(F.first(text).alias(text), F.count(F.lit(1)).alias("_copies"))
    once = once.withColumn("_salts", F.ceil(F.col("_copies") / limit).cast("int"))
    # At most rows / limit entries.
    hot = F.broadcast(keyed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_copies"))
                      .filter(F.col("_copies") > limit)
                      .select("_digest", F.ceil(F.col("_copies") / limit).cast("int").alias("_salts")))
    left = keyed.select("seq", "_digest").join(hot, "_digest", "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64("seq"), F.col("_salts")))
        .otherwise(0).cast("int"))
    right = embed(once).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return left.join(right.select("_digest", "_salt", "embedding"), ["_digest", "_salt"]).select("seq", "embedding")
