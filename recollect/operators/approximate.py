"""Approximate nearest neighbours by random projections."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators.retrieval import HITS, _matrix, _nearest, knn, usable
from recollect.session import written

BUCKET = 256     # wanted number of vectors in a bucket
MOST_BITS = 16   # so at most 65,536 buckets
CHUNK = 20_000   # vectors of a bucket met at once; a larger bucket is met in several chunks
SAMPLE = 64      # queries whose exact neighbours decide how many buckets are probed


class Projections:
    """Buckets by the signs of random projections about a centre."""

    def __init__(self, centre, bits, seed=11):
        self.centre = np.asarray(centre, np.float64)
        self.planes = np.random.default_rng(seed).normal(size=(len(self.centre), bits))
        self.bits = bits

    def margins(self, vectors):
        return (vectors - self.centre) @ self.planes

    def buckets(self, vectors):
        return (self.margins(vectors) > 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def order(self, vector):
        """All buckets, the likeliest first: by the squared margins that would have to change."""
        m = self.margins(vector[None])[0]
        cost = np.zeros(1)
        for j in range(self.bits):  # bucket numbers as they double with each bit
            flip = m[j] ** 2
            low, high = (cost + flip, cost) if m[j] > 0 else (cost, cost + flip)
            cost = np.concatenate((low, high))
        return np.argsort(cost, kind="stable")


def approx_knn(vectors, queries, k, target=0.95, bits=None, seed=11):
    """(query_id, seq, distance, rank): about the k nearest rows (squared distance) per query.

    vectors: seq, embedding. queries: query_id, embedding. Every usable vector is indexed, under
    the signs of random projections. A query probes the buckets nearest to it, and what it meets
    is measured exactly. How many it probes is fitted: up to SAMPLE queries are answered
    exactly, and the number is the least that finds `target` of their neighbours. Vectors are
    shuffled once, by bucket; a bucket of very many is met in chunks. Ties go to the smaller seq.
    Null vectors and those of another width take no part; no queries give no rows.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], HITS + ", rank int")
    dim = queries.agg(F.max(F.size("embedding"))).first()[0]
    if not dim or dim < 1:
        return empty
    vectors, queries = usable(vectors.select("seq", "embedding"), dim), usable(queries.select("query_id", "embedding"), dim)
    n = vectors.count()
    if not n:
        return empty
    bits = bits or int(np.clip(np.ceil(np.log2(n / BUCKET)), 1, MOST_BITS))
    one = vectors.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x"))
    made = Projections([r["x"] for r in one.orderBy("at").collect()], bits, seed)  # `dim` numbers

    def keyed(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(made.buckets(_matrix(b.column(1)))), b.column(0), b.column(1)],
                                                 names=["bucket", "seq", "embedding"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    index = written(vectors.mapInArrow(keyed, f"bucket bigint, seq bigint, embedding {kind}"), "projections")
    probes = _fit(index, queries, made, k, target)

    def probing(batches):
        for b in batches:
            for i, q in enumerate(_matrix(b.column(1)) if b.num_rows else []):
                yield pa.RecordBatch.from_arrays([pa.array(made.order(q)[:probes]), *[c.take(pa.array(np.full(probes, i))) for c in b.columns]],
                                                 names=["bucket", "query_id", "embedding"])

    sizes = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "bucket", F.ceil(F.col("_n") / CHUNK).cast("int").alias("chunks"))  # at most 2 ** MOST_BITS rows
    kind = queries.schema["embedding"].dataType.simpleString()
    asked = queries.mapInArrow(probing, f"bucket bigint, query_id bigint, embedding {kind}").join(F.broadcast(sizes), "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "query_id", "embedding")
    held = index.join(F.broadcast(sizes), "bucket").select(
        "bucket", F.pmod(F.xxhash64("seq"), F.col("chunks")).cast("int").alias("chunk"), "seq", "embedding")

    def meet(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "seq": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        got = _nearest(left.column("query_id").to_numpy(), _matrix(left.column("embedding").combine_chunks()),
                       right.column("seq").to_numpy(), _matrix(right.column("embedding").combine_chunks()), k, "l2")
        return pa.table(dict(zip(("query_id", "seq", "distance"), got)))

    found = asked.groupBy("bucket", "chunk").cogroup(held.groupBy("bucket", "chunk")).applyInArrow(meet, HITS)
    w = Window.partitionBy("query_id").orderBy("distance", "seq")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _fit(index, queries, made, k, target):
    """The least number of probed buckets that finds `target` of the exact neighbours of a sample."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE)
    asked = {r["query_id"]: np.asarray(r["embedding"], np.float64) for r in sample.collect()}  # at most SAMPLE
    hits = knn(index.select("seq", "embedding"), sample, k)
    true = hits.join(index.select("seq", "bucket"), "seq").select("query_id", "bucket").collect()  # SAMPLE * k
    if not true:
        return 1
    place = {q: np.argsort(made.order(v)) for q, v in asked.items()}
    ranks = np.sort([place[r["query_id"]][r["bucket"]] for r in true])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1
