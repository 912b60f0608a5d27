"""Retrieval: exact nearest neighbours, filters, keyword search, context per question."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import payload as J
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators.timeline import newest, newest_first
from recollect.session import written

# Up to this many query vectors go to every task; more are met block by block.
MAX_SHARED_QUERIES = 2048
# Beyond that: queries and vectors per block, and queries per matrix product.
BLOCK_QUERIES = 16_384
BLOCK_VECTORS = 100_000
QUERY_STEP = 256
CONTEXT_CHARS = 2500


def _distance(vectors, q, metric):
    if metric == "l2":
        return ((vectors - q) ** 2).sum(axis=1)
    norms = np.sqrt((vectors ** 2).sum(axis=1)) * np.sqrt((q ** 2).sum())
    dots = (vectors * q).sum(axis=1)
    return 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _rough(vectors, queries, metric):
    """All distances of a block by one matrix product, exact but for rounding."""
    if metric == "l2":
        return (vectors ** 2).sum(axis=1)[:, None] - 2.0 * (vectors @ queries.T) + (queries ** 2).sum(axis=1)
    vn, qn = (np.sqrt((m ** 2).sum(axis=1, keepdims=True)) for m in (vectors, queries))
    return 1.0 - np.divide(vectors, vn, out=np.zeros_like(vectors), where=vn > 0) @ \
        np.divide(queries, qn, out=np.zeros_like(queries), where=qn > 0).T


def _nearest(qids, queries, seqs, vectors, k, metric):
    """The k nearest of one block for each query, as three flat arrays.

    The matrix product finds candidates with room for its rounding; they are
    measured again one by one, so equal vectors tie exactly and seq decides."""
    out_q, out_s, out_d = [], [], []
    room = 1e-9 * (1.0 + (vectors ** 2).sum(axis=1).max() + (queries ** 2).sum(axis=1).max())
    for lo in range(0, len(queries), QUERY_STEP):
        rough = _rough(vectors, queries[lo:lo + QUERY_STEP], metric)
        for j in range(rough.shape[1]):
            near = rough[:, j]
            if len(near) > k:
                at = np.flatnonzero(near <= np.partition(near, k - 1)[k - 1] + room)
            else:
                at = np.arange(len(near))
            dist = _distance(vectors[at], queries[lo + j], metric)
            best = np.lexsort((seqs[at], dist))[:k]
            out_q.append(np.full(len(best), qids[lo + j]))
            out_s.append(seqs[at][best])
            out_d.append(dist[best])
    return np.concatenate(out_q), np.concatenate(out_s), np.concatenate(out_d)


def _matrix(column):
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


HITS = "query_id bigint, seq bigint, distance double"


def _scan(vectors, queries, k, metric):
    """One pass over the vectors; each batch keeps k rows per query."""
    qids = np.array([r["query_id"] for r in queries], dtype=np.int64)
    mat = np.array([r["embedding"] for r in queries], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((qids, mat))

    def run(batches):
        ids, qs = shared.value
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            got = _nearest(ids, qs, b.column("seq").to_numpy(), _matrix(b.column("embedding")), k, metric)
            best = got if best is None else _merge(best, got, k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best],
                                             ["query_id", "seq", "distance"])

    return vectors.select("seq", "embedding").mapInArrow(run, HITS)


def _merge(a, b, k):
    q, s, d = (np.concatenate(p) for p in zip(a, b))
    order = np.lexsort((s, d, q))
    q, s, d = q[order], s[order], d[order]
    start = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    keep = rank < k
    return q[keep], s[keep], d[keep]


def _blocks(vectors, queries, n_queries, k, metric):
    """Many queries: blocks of queries meet blocks of vectors, both bounded."""
    q_parts = max(1, -(-n_queries // (BLOCK_QUERIES // 2)))   # half full on average
    v_parts = max(1, -(-vectors.count() // (BLOCK_VECTORS // 2)))
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).alias("_q"),
                       F.explode(F.sequence(F.lit(0), F.lit(v_parts - 1))).alias("_v"))
    v = (vectors.withColumn("_v", F.pmod(F.xxhash64("seq"), F.lit(v_parts)).cast("int"))
         .select("seq", "embedding", "_v", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("_q"))
         .withColumn("_q", F.col("_q").cast("long")))

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "seq": pa.array([], pa.int64()),
                             "distance": pa.array([], pa.float64())})
        got = _nearest(left.column("query_id").to_numpy(), _matrix(left.column("embedding").combine_chunks()),
                       right.column("seq").to_numpy(), _matrix(right.column("embedding").combine_chunks()),
                       k, metric)
        return pa.table(dict(zip(("query_id", "seq", "distance"), got)))

    return q.groupBy("_q", "_v").cogroup(v.groupBy("_q", "_v")).applyInArrow(meet, HITS)


def knn(vectors, queries, k, metric="l2", max_shared=None):
    """V1 core: (query_id, seq, distance, rank) of the k nearest rows per query.

    Exact.  Vectors are never shuffled while the queries fit the shared bound."""
    return _knn(vectors, queries, k, metric, max_shared)[0]


def usable(rows, dim):
    """Rows whose vector has `dim` components, none of them null."""
    return rows.filter((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))


def _knn(vectors, queries, k, metric, max_shared):
    """Rows and queries without a full vector take no part; the queries set the width."""
    max_shared = MAX_SHARED_QUERIES if max_shared is None else max_shared
    dim = queries.agg(F.max(F.size("embedding"))).first()[0]
    if not dim or dim < 1:
        return vectors.sparkSession.createDataFrame([], HITS + ", rank int"), True
    vectors, queries = usable(vectors, dim), usable(queries, dim)
    few = queries.select("query_id").limit(max_shared + 1).count() <= max_shared
    if few:
        rows = queries.select("query_id", "embedding").collect()  # bounded by max_shared
        if not rows:
            return vectors.sparkSession.createDataFrame([], HITS + ", rank int"), few
        partial = _scan(vectors, rows, k, metric)
    else:
        partial = _blocks(vectors, queries, queries.count(), k, metric)
    w = Window.partitionBy("query_id").orderBy("distance", "seq")
    return partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), few


def knn_filtered(memory, queries, k, condition=None, metric="l2"):
    """V1: nearest rows under a scalar filter, with the rows' own columns."""
    rows = memory if condition is None else memory.filter(condition)
    hits, few = _knn(rows, queries, k, metric, None)
    # With few queries there are at most k * MAX_SHARED_QUERIES hits, so they go
    # to the rows; otherwise both sides meet by key.
    return rows.drop("embedding").join(F.broadcast(hits) if few else hits, "seq")


def _detailed(hits, details):
    return hits if details is None else details(hits)


def find_relevant(memory, queries, k, details=None):
    """V2: the texts nearest to each query.

    details: adds the texts to the hits, so that a search reads keys and vectors only; without
    it `memory` has them. So in all searches below."""
    return _detailed(knn_filtered(memory, queries, k), details).select("query_id", "rank", "text")


def count_relevant(memory, summaries, queries, cap=5):
    """V3: hits per query among raw rows and among rollups, each capped."""
    def count(rows, name):
        return knn(rows, queries, cap).groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
    return (queries.select("query_id").join(count(memory, "raw"), "query_id", "left")
            .join(count(summaries, "rolled"), "query_id", "left").fillna(0, ["raw", "rolled"]))


def search_by_filter(memory, queries, limit, time_from=None, time_to=None, app=None,
                     mode="postfilter", details=None):
    """V4: nearest rows, then time range and app; newest first.

    `postfilter` looks at 4 x limit neighbours and may return fewer rows;
    `prefilter` filters first and is never short."""
    secs = C.div(C.micros("time_start"), F.lit(1_000_000).cast("long"))
    cond = F.lit(True)
    if time_from is not None:
        cond = cond & (secs >= time_from)
    if time_to is not None:
        cond = cond & (secs <= time_to)
    if app is not None:
        cond = cond & F.lower("app_name").contains(app.lower())
    if mode == "prefilter":
        hits = knn_filtered(memory, queries, limit, cond)
    else:
        hits = knn_filtered(memory, queries, 4 * limit).filter(cond)
    w = Window.partitionBy("query_id").orderBy(*newest_first())
    line = F.concat(F.lit("["), C.fmt_ts("time_start"), F.lit("] ["), "app_name", F.lit("] "),
                    F.substring("text", 1, 200))
    chosen = hits.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)
    return _detailed(chosen, details).select("query_id", "pos", line.alias("line"))


def archive_keyword_search(archive, keyword, limit):
    """V5: archived rows whose preview holds the keyword, newest first."""
    rows = archive.withColumn("preview", J.text_preview("data_json"))
    hits = rows.filter(F.lower("preview").contains(keyword.lower()))
    return newest(hits, limit).select("time_start", F.concat(
        F.lit("["), C.fmt_ts("time_start"), F.lit("] "), "preview").alias("line"))


def embed_text(rows, text, dim=384):
    """Deterministic hashed term counts of a text, as a float array."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array
    tf = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf")
    out = tf.transform(rows.withColumn("_words", T.words(text)))
    return out.withColumn("embedding", vector_to_array("_tf", "float32")).drop("_words", "_tf")


# --- context per question -------------------------------------------------------

def _joined(rows, order, piece, sep=""):
    """One string per query from a few rows (k at most), in order."""
    return rows.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(*order, piece.alias("_piece")))),
        lambda r: r["_piece"]), sep).alias("_block"))


def _by_time_desc():
    return [(-C.micros("time_start")).alias("_t"), (-F.col("seq")).alias("_s")]


def smart_rag(memory, summaries, questions, log_lines, as_of, details=None, previews=None):
    """V6: per question, recent screen log, nearest summaries and nearest events.

    memory / summaries  rows with vectors; log_lines is one text, already built
    questions           query_id, text, embedding
    details / previews  add the texts of memory and summary hits, where the rows lack them"""
    asked = questions.select("query_id", K.is_screen_query("text").alias("want_screen"))
    rolled = _detailed(knn_filtered(summaries, questions, 5), previews)
    piece = F.concat(F.lit("["), C.fmt_ts("time_start"), F.lit(" · "), C.rel_age("time_start", as_of),
                     F.lit("] "), "preview", F.lit("\n\n"))
    rolled = _joined(rolled, _by_time_desc(), piece).withColumnRenamed("_block", "_rolled")

    raw = knn_filtered(memory, questions, 8).join(asked, "query_id")
    keep = ~F.col("app_name").isin("user", "system") & (
        F.col("want_screen") | F.col("app_name").isin("dialogue", "note"))
    w = Window.partitionBy("query_id").orderBy(*newest_first())
    raw = _detailed(raw.filter(keep).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 5), details)
    s = C.age_seconds("time_start", as_of)
    age = F.when(s < 3600, F.concat(C.div(s, F.lit(60).cast("long")).cast("string"), F.lit(" min ago"))) \
        .otherwise(F.concat(C.div(s, F.lit(3600).cast("long")).cast("string"), F.lit(" h ago")))
    tag = F.when(F.col("app_name") == "", F.lit("")).otherwise(
        F.concat(F.lit(" ["), "app_name", F.lit("]")))
    piece = F.concat(F.lit("["), C.fmt_ts("time_start"), F.lit("]"), tag, F.lit(" ("), age, F.lit(")\n"),
                     T.summarize_code("text"), F.lit("\n\n"))
    raw = _joined(raw, [F.col("_n")], piece).withColumnRenamed("_block", "_raw")

    rows = asked.join(rolled, "query_id", "left").join(raw, "query_id", "left")
    screen = F.when(F.col("want_screen"), log_lines).otherwise(F.lit(""))
    out = F.concat(screen,
                   F.coalesce(F.concat(F.lit("Summaries (newest first):\n"), "_rolled"), F.lit("")),
                   F.coalesce(F.concat(F.lit("\n## Similar events\n"), "_raw"), F.lit("")))
    return rows.select("query_id", "want_screen", F.when(out == "", F.lit(rules.NOTHING_FOUND))
                       .otherwise(F.substring(out, 1, CONTEXT_CHARS)).alias("context"))


def screen_block(log, snapshot=None):
    """The recent-activity part of a context as one value: a few log lines
    (bounded by the log's limit), else the last snapshot."""
    lines = [r["line"] for r in log.orderBy(*newest_first()).collect()]  # at most the log's n rows
    if lines:
        return F.lit("Screen activity (newest first):\n" + "".join(f"- {x}\n" for x in lines) + "\n")
    last = snapshot().select(C.fmt_ts("time_start").alias("at"), "text").first() if snapshot else None
    return F.lit(f"[CURRENT_SCREEN {last['at']}]\n{last['text']}\n\n" if last else "")


def legacy_timeline(memory, questions, recent=3, k=10, details=None):
    """V8: the nearest rows newest first; three in full, the rest compressed."""
    hits = _detailed(knn_filtered(memory, questions, k), details)
    w = Window.partitionBy("query_id").orderBy(*newest_first())
    ranked = hits.withColumn("_n", F.row_number().over(w))
    full = F.concat(F.lit("["), C.fmt_ts("time_start"), F.lit("] "), "app_name", F.lit(" / "),
                    "window_title", F.lit("\n"), T.summarize_code("text"))
    short = F.concat("app_name", F.lit(" ("), "window_title", F.lit("): "), F.substring("text", 1, 120))
    top = _joined(ranked.filter(F.col("_n") <= recent), [F.col("_n")], full, "\n\n")
    rest = _joined(ranked.filter(F.col("_n") > recent), [F.col("_n")], short, "\n") \
        .withColumnRenamed("_block", "_rest")
    tail = F.coalesce(F.concat(F.lit("\n\n## Historical context\n"), F.substring("_rest", 1, 300)), F.lit(""))
    return top.join(rest, "query_id", "left").select("query_id", F.substring(
        F.concat(F.lit("## Recent events\n"), "_block", tail), 1, CONTEXT_CHARS).alias("context"))


def topic_timeline_rag(smart, memory, questions, details=None):
    """V7: `smart`, or the older timeline where a screen question found nothing."""
    smart = written(smart, "context")   # one short row per question, used twice
    empty = (F.col("context") == rules.NOTHING_FOUND) & F.col("want_screen")
    todo = questions.join(smart.filter(empty).select("query_id"), "query_id", "left_semi")
    older = legacy_timeline(memory, todo, details=details).withColumnRenamed("context", "_older")
    return smart.join(older, "query_id", "left").select(
        "query_id", "want_screen", F.coalesce("_older", "context").alias("context"))
