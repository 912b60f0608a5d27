"""Connected components of a link table by alternating large and small stars."""

from pyspark.sql import functions as F

from recollect.llm.common import is_empty, stored


def _turn(a, b):
    """Each link once, from its larger to its smaller end."""
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def components(links, name="stars"):
    """links: `a`, `b` (long). Returns `a`, `b`: every linked value that is not the
    smallest of its component, with that smallest value.

    Each round ties the larger neighbours of a value, then the smaller ones, to the
    smallest; the number of links does not grow, and rounds grow with the logarithm of
    the longest chain. Minima are combined before the shuffle and a value with very
    many links is a skewed join key, which Spark splits. Rounds are written, so lost
    executors cost one round at most.
    """
    edges = stored(links.where("a <> b").select(*_turn(F.col("a"), F.col("b"))).distinct(), name)
    if is_empty(edges):
        return edges
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            return edges
        seen = now
