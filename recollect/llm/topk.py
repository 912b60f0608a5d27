"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Every dimension is a term. A task lays out its share of the vectors as postings (term,
vectors with a nonzero weight, weights); the queries are sparse rows whose weighted
postings are scattered, term after term, into dense score arrays. The k best of a
task are chosen by partition selection and the tasks' lists are merged by rank.

Queries go to the tasks in blocks of at most about `block` rows (a stated bound on
what is broadcast); each block is one pass over the vectors, which are never shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.common import stored

ROWS = 4096  # vectors scored at once


def integer_vectors(vectors, scale=1024):
    """`vec_id`, `weights` array<double> holding floor(scale * x); vectors that are null
    or hold a null, a NaN or an infinity are left out."""
    whole = vectors.where(F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    exact = F.lit(2.0 ** 53)  # doubles from here on are whole numbers, and floor() gives a long

    def floor(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < exact, F.floor(y).cast("double")).otherwise(y)

    return whole.select("vec_id", F.transform("embedding", floor).alias("weights"))


def _postings(ids, lists):
    """Postings by term of some vectors: {term: (rows, weights)}; exact integers."""
    size = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    flat = np.concatenate([np.asarray(x, np.float64) for x in lists]) if len(lists) else np.zeros(0)
    row = np.repeat(np.arange(len(lists)), size)
    term = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    used = np.flatnonzero(flat)
    used = used[np.argsort(term[used], kind="stable")]
    cuts = np.flatnonzero(np.diff(term[used])) + 1
    return {int(term[p[0]]): (row[p], flat[p]) for p in np.split(used, cuts) if len(p)}


def _whole(values, small):
    """int64 where all sums fit, Python integers beyond."""
    return values.astype(np.int64) if small else np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def _scores(queries, postings, n, width, small):
    out = np.zeros((len(queries), n), np.int64 if small else object)
    for term in range(width):
        column = np.array([q[term] if term < len(q) else 0.0 for q in queries])
        hit = np.flatnonzero(column)
        if term in postings and len(hit):
            rows, weights = postings[term]
            add = _whole(column[hit], small)[:, None] * _whole(weights, small)[None, :]
            if len(rows) == n:
                out[hit] += add
            else:
                out[np.ix_(hit, rows)] += add
    return out if small else np.clip(out, -(1 << 63), (1 << 63) - 1)


def _best(scores, ids, own, k):
    """Up to k places by score, then smaller id, leaving out the query's own id."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        s = scores[places]
        edge = np.partition(s, len(s) - k)[len(s) - k]
        places = places[s >= edge]
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def _scan(queries, k):
    own = np.array([q[0] for q in queries], np.int64)
    weights = [np.array(q[1], np.float64) for q in queries]
    width = max((len(w) for w in weights), default=0)
    top = max((float(np.abs(w).max()) for w in weights if len(w)), default=0.0)
    names = ["query_id", "vec_id", "score"]

    def pick(ids, lists):
        peak = max((max(map(abs, x), default=0.0) for x in lists), default=0.0)
        small = peak * top * max(width, 1) < 2.0 ** 62
        scores = _scores(weights, _postings(ids, lists), len(ids), width, small)
        for q in range(len(weights)):
            at = _best(scores[q], ids, own[q], k)
            yield own[q], ids[at], scores[q][at]

    def run(batches):
        best = {}
        for b in batches:
            for start in range(0, b.num_rows, ROWS):
                part = b.slice(start, ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for q, (qid, vec, score) in enumerate(pick(ids, part.column(1).to_pylist())):
                    if q in best:
                        vec, score = np.concatenate((best[q][1], vec)), np.concatenate((best[q][2], score))
                        at = np.lexsort((vec, -score))[:k]
                        vec, score = vec[at], score[at]
                    best[q] = (qid, vec, score)
        if best:
            lists = [x for x in best.values() if len(x[1])]
            if lists:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(v), q) for q, v, _ in lists])),
                     pa.array(np.concatenate([v for _, v, _ in lists])),
                     pa.array([int(s) for _, _, ss in lists for s in ss], pa.int64())], names=names)

    return run


def top_k(vectors, k=10, every=100, scale=1024, block=1024):
    """`query_id`, `rank` (from 1), `vec_id`, `score`: for each row whose vec_id is
    divisible by `every`, the k rows of another vec_id with the highest inner product
    of the integer vectors; ties to the smaller vec_id.

    Rows with a null vec_id take no part, nor do null vectors or those with null or
    non-finite components. Vectors of different lengths: missing components are zero;
    an empty vector scores zero. A repeated row stands among the candidates as often as
    it occurs; as a query, equal rows count once. Scores are exact; one beyond 64 bits
    counts as the nearest long. An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale)
    queries = rows.where(F.col("vec_id") % every == 0).distinct()
    blocks = max(1, -(-queries.count() // block))
    found = None
    for b in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if not chosen:
            continue
        chosen = sorted((r["vec_id"], list(r["weights"])) for r in chosen)
        one = rows.mapInArrow(_scan(chosen, k), "query_id long, vec_id long, score long")
        one = stored(one, "top-k-block") if blocks > 1 else one
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
