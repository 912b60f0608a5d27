"""Line dedup: lines that many documents hold stay in one of them only.

Native DataFrame functions throughout. Lines are normalised and hashed to 128 bits
(two 64-bit hashes with different seeds); a hash is counted once per document, with
map-side combining, so a line that a third of all documents holds costs one row per
task. The lines over the threshold form a small table, which is written; Spark joins
it by broadcast or by a skew-aware shuffle, as its size allows. Documents get back
the positions of their dropped lines and are put together again by position.
"""

from pyspark.sql import functions as F

from recollect.llm.common import stored

BLANK = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line):
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _hashes(key):
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")


def dedup_lines(docs, min_chars=40, min_docs=5):
    """Drop lines whose key has at least `min_chars` code points and stands in at
    least `min_docs` documents, except in the document with the largest doc_id.

    Returns `row` (all columns as they came, so no name can clash), `n_lines`,
    `n_dropped` and `kept_text`.

    Null or empty text: one empty line. A row is a document: a repeated row counts
    again, and every row with the largest doc_id keeps its lines. Null doc_ids are
    smaller than all others. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    lines = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    base = rows.select(F.col("row.doc_id").alias("doc_id"), lines.alias("lines"),
                       F.xxhash64("row.text").alias("text_hash"))

    keys = F.array_distinct(F.filter(F.transform("lines", line_key), lambda k: F.length(k) >= min_chars))
    common = stored(
        base.select("doc_id", F.explode(keys).alias("key")).select("doc_id", *_hashes(F.col("key")))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "common-lines")

    dropped = (
        base.select("doc_id", "text_hash", F.posexplode("lines").alias("pos", "line"))
        .where(F.octet_length("line") >= min_chars)
        .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", *_hashes(F.col("key")))
        .join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "text_hash").agg(F.array_distinct(F.collect_list("pos")).alias("dropped")))

    out = rows.withColumn("text_hash", F.xxhash64("row.text")).alias("d").join(
        dropped.alias("x"),
        F.col("row.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("d.text_hash") == F.col("x.text_hash")), "left")
    last = F.size(lines) - 1
    stay = F.array_except(F.sequence(F.lit(0), last), F.col("dropped"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return out.select(
        "row", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(kept).alias("kept_text"))
