"""Quality rules with adaptive thresholds.

Each measure is an integer per document. A mergeable quantile sketch per (lang, source)
is a table of counts by rounded value: values keep their seven leading bits, so a
quantile is off by less than 1/64 of itself, the number of buckets is bounded, and
sketches merge by adding counts, with map-side combining and the same result in any
order. Thresholds come from the sketches and are joined back to the documents.

A measure fails above `upper quartile + reach * spread`, where the spread is that
between the quartiles but at least a floor, and the median word length fails below the
mirrored border as well. Thresholds thus follow each language and source; a group of
fewer than `least_rows` documents uses its language's sketch, and a language with fewer
uses that of all documents.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.llm.common import in_parts, stored, utf8

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5


def repeat_words(words, width=WINDOW):
    """Words inside windows of `width` words that occur twice or more in the list."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    index = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    rank = ids[:n]
    for step in range(1, width):  # exact ranks of ever longer windows
        _, rank = np.unique(rank * len(index) + ids[step:step + n], return_inverse=True)
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = utf8(text).split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
# measure: (expression in ten thousandths, least spread, has a lower border too)
RULES = {
    "word_length": ("word_chars * 10000 div n_words", 10000, True),
    "symbols": ("n_symbols * 10000 div word_chars", 200, False),
    "dup_lines": ("n_dup_lines * 10000 div n_lines", 1150, False),
    "repeats": ("n_repeat_words * 10000 div n_words", 650, False),
}


def measures(docs):
    """doc_id, lang, source and the counts per row of docs."""
    kinds = {n: docs.schema[n].dataType.simpleString() for n in ("doc_id", "lang", "source")}

    def run(batches):
        for b in in_parts(batches):
            rows = np.array([measure(t.as_py()) for t in b.column(3)], np.int64).reshape(b.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, rows.T.copy())],
                                             names=["doc_id", "lang", "source", *COUNTS])

    head = ", ".join(f"{n} {k}" for n, k in kinds.items())
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(
        run, head + "".join(f", {c} bigint" for c in COUNTS))


def sketches(rows):
    """Counts by (level, lang, source, rule, bucket): level 0 for a language and source,
    1 for a language, 2 for all."""
    sketch = rows.select("lang", "source", F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("value")) for n in RULES])).alias("v")).select(
        "lang", "source", "v.rule", "v.value").where("value is not null")
    sketch = sketch.withColumn("shift", F.greatest(F.length(F.bin("value")) - 7, F.lit(0))).withColumn(
        "bucket", F.expr("shiftleft(shiftright(value, shift), shift)"))
    fine = sketch.groupBy("lang", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    return fine.select(F.lit(0).alias("level"), "lang", "source", "rule", "bucket", "n").unionByName(
        fine.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
        .select(F.lit(1).alias("level"), "lang", none.alias("source"), "rule", "bucket", "n")).unionByName(
        fine.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
        .select(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"), "rule", "bucket", "n"))


def thresholds(sketch, reach, least_rows):
    """One row per level, lang and source with the borders of every rule."""
    group = ["level", "lang", "source", "rule"]
    upto = Window.partitionBy(*group).orderBy("bucket")
    whole = Window.partitionBy(*group)
    marked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))

    def quantile(q):
        return F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))

    quart = marked.groupBy(*group).agg(quantile(25).alias("q1"), quantile(75).alias("q3"), F.max("total").alias("total"))
    quart = quart.where((F.col("total") >= least_rows) | (F.col("level") == 2))
    floor = F.create_map(*[F.lit(x) for n, (_, least, _) in RULES.items() for x in (n, least)])
    spread = F.greatest(F.col("q3") - F.col("q1"), floor[F.col("rule")])
    borders = quart.withColumn("low", F.col("q1") - spread * reach).withColumn("high", F.col("q3") + spread * reach)
    return borders.groupBy("level", "lang", "source").agg(*[
        F.max(F.when(F.col("rule") == n, F.struct("low", "high"))).alias(n) for n in RULES])


def filter_quality(docs, min_words=10, max_repeat_percent=20, reach=3, least_rows=50):
    """Per row of docs: doc_id, the counts, `base_failed`, `failed_rules` (names of the
    adaptive rules it fails) and `kept`.

    Null, empty or blank text: no words, fails the base rules. Null languages and
    sources are groups of their own. Measures of a document without words are null and
    enter no sketch. Values equal to a border pass. Repeated rows count in the sketches
    as often as they occur. An empty table gives an empty table.
    """
    rows = measures(docs).select("*", *[
        F.expr(f"case when n_words > 0 then {e} end").alias(n) for n, (e, _, _) in RULES.items()])
    rows = stored(rows, "quality-counts")
    borders = stored(thresholds(sketches(rows), reach, least_rows), "quality-borders")

    def at(level, *keys):
        part = borders.where(F.col("level") == level).select(
            *[F.col(k).alias(f"k{level}_{k}") for k in keys],
            F.struct(*[F.col(n) for n in RULES]).alias(f"b{level}"))
        return part

    on = lambda level, *keys: [F.col(k).eqNullSafe(F.col(f"k{level}_{k}")) for k in keys]
    joined = rows.join(at(0, "lang", "source"), on(0, "lang", "source"), "left").join(at(1, "lang"), on(1, "lang"), "left")
    general = at(2).collect()  # one row
    general = general[0]["b2"].asDict(True) if general else {}
    tests = []
    for n, (_, _, lower) in RULES.items():
        whole = general.get(n) or {"low": None, "high": None}
        high = F.coalesce(F.col(f"b0.{n}.high"), F.col(f"b1.{n}.high"), F.lit(whole["high"]).cast("long"))
        low = F.coalesce(F.col(f"b0.{n}.low"), F.col(f"b1.{n}.low"), F.lit(whole["low"]).cast("long"))
        bad = F.col(n) > high
        tests.append(F.when(bad | (F.col(n) < low) if lower else bad, F.lit(n)))
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), F.array_compact(F.array(*tests)).alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
