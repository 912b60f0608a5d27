"""Aggregations: counts, activity, hour and week rollups, latency statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import payload as J
from recollect.functions import times as C
from recollect.operators.ordered import HOT_ROWS, Ordered

EMBED_CHARS = 2000
# 1000 texts of one character, joined by line ends, already fill 1999 characters;
# so the first 1000 texts, and whether more follow, decide the first 2000.
EMBED_TEXTS = 1000
# The same bound for 200-character previews joined into a 300-character summary.
SUMMARY_CHARS = 300
SUMMARY_TEXTS = 301
SUB_EVENT_CHUNK = 10_000


def app_event_counts(memory):
    """G1."""
    return memory.groupBy("app_name").agg(F.count(F.lit(1)).alias("n"))


def activity_for_days(memory, as_of, days, zone="UTC", snippet=80):
    """Per app, the number of rows since the local midnight `days` back and
    the first snippet worth showing."""
    rows = memory.filter((F.col("time_start") >= C.local_midnight_cutoff(as_of, days, zone))
                         & ~F.col("app_name").isin(rules.SUMMARY_SKIP_APPS))
    long_enough = F.octet_length("text") > 10
    cut = F.substring("text", 1, snippet)
    out = rows.groupBy("app_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(long_enough, cut), F.when(long_enough, F.struct("time_start", "seq")))
        .alias("snippet"))
    line = F.concat(F.lit("- "), "app_name", F.lit(" ("), F.col("n").cast("string"), F.lit(" events)"),
                    F.coalesce(F.concat(F.lit(': "'), "snippet", F.lit('"')), F.lit("")))
    return out.select("app_name", "n", line.alias("line"))


def activity_hourly(memory, as_of, hours):
    """Rows per hour over the last `hours`, empty hours included.

    The spine of hours is generated, not read; its length is the parameter."""
    spark = memory.sparkSession
    end = C.hour_bucket(as_of)
    start_us = C.micros(as_of) - F.lit(hours * C.HOUR_US).cast("long")
    counts = (memory.filter(F.col("time_start") >= C.from_micros(start_us))
              .groupBy((C.hour_bucket("time_start") * 3600).alias("hour_s"))
              .agg(F.count(F.lit(1)).alias("n")))
    spine = spark.range(hours).select(((end - (hours - 1) + F.col("id")) * 3600).alias("hour_s"))
    return spine.join(counts, "hour_s", "left").select(
        "hour_s", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def _first_texts(rows, bucket, order, chars, keep):
    """Per bucket, the leading non-empty texts whose join fills `chars` characters.

    A first pass without texts finds how far into each bucket that goes: its
    rank limit prunes before the shuffle, so a full bucket sends at most `keep`
    short rows per task.  The second pass ships only the texts that are needed;
    the border is one row per bucket, and buckets are spans of time."""
    w = Window.partitionBy(bucket).orderBy(*order)
    short = (rows.filter(F.col("text") != "")
             .select(bucket, *order, F.least(F.length("text"), F.lit(chars)).alias("_len"))
             .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep))
    before = F.sum(F.col("_len") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # A text that begins right behind the limit still puts its separator inside.
    border = (short.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= chars)
              .groupBy(bucket).agg(F.max(F.struct(*order)).alias("_border")))
    lead = (rows.filter(F.col("text") != "")
            .select(bucket, F.struct(*order).alias("_at"), F.substring("text", 1, chars).alias("_text"))
            .join(F.broadcast(border), bucket).filter(F.col("_at") <= F.col("_border")))
    return lead.groupBy(bucket).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_text"))),
                    lambda r: r["_text"]).alias("_texts"))


def rollup_hour_l1(memory):
    """One header per hour: span, count and the text to embed."""
    rows = memory.withColumn("hour", C.hour_bucket("time_start"))
    heads = rows.groupBy("hour").agg(
        F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        F.count(F.lit(1)).alias("count"),
        F.sum(F.when(F.col("text") != "", 1).otherwise(0)).alias("_texts_n"))
    texts = _first_texts(rows, "hour", ["time_start", "seq"], EMBED_CHARS, EMBED_TEXTS)
    joined = F.concat(F.array_join("_texts", "\n"),
                      F.when(F.col("_texts_n") > EMBED_TEXTS, "\n").otherwise(""))
    return heads.join(texts, "hour", "left").select(
        "hour", "time_start", "time_end", "count",
        F.coalesce(F.substring(joined, 1, EMBED_CHARS), F.lit("")).alias("embed_text"))


def rollup_hour_sub_events(memory, limit=HOT_ROWS, details=None):
    """The ordered members of each hour record, one row each.

    Kept as rows with a position: an array per hour would have no bound. details: adds texts to
    rows with a seq, once each; ordering then shuffles no texts."""
    rows = memory.withColumn("hour", C.hour_bucket("time_start"))
    e = J.sub_event(C.micros("time_start"), "app_name", "text")
    out = _positions(rows, limit)
    out = out if details is None else details(out)
    return out.select("hour", (F.col("pos") - 1).alias("pos"), "id", e.alias("e")) \
        .select("hour", "pos", "id", "e.*")


def _positions(rows, limit):
    """Rows with their place in their hour, from 1."""
    o = Ordered(rows, ["hour"], ["time_start", "seq"], C.micros("time_start"), limit)
    o.running_sum(F.lit(1), "pos")
    return o.result()


def hour_record_parts(sub_events, chunk=SUB_EVENT_CHUNK):
    """The hour members packed into JSON records of bounded size."""
    part = C.div(F.col("pos"), F.lit(chunk).cast("long"))
    return _packed(sub_events.withColumn("part", part), "pos")


def _packed(members, *order):
    """Members (with hour, part) as one JSON record for each part."""
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, "t", "act", "ocr_full", "clipboard"])))),
        lambda e: F.struct(e["t"].alias("t"), e["act"].alias("act"),
                           e["ocr_full"].alias("ocr_full"), e["clipboard"].alias("clipboard")))
    # Dealt first: a task would otherwise gather lists of all hours, and sort and spill their texts.
    return (members.repartition("hour", "part").groupBy("hour", "part")
            .agg(ordered.alias("sub_events"), F.count(F.lit(1)).alias("count"))
            .select("hour", "part", F.to_json(F.struct("sub_events", "count")).alias("data_json")))


def hour_records(memory, chunk=SUB_EVENT_CHUNK, limit=HOT_ROWS):
    """The records that `hour_record_parts` makes of the `rollup_hour_sub_events` of rows, whose
    texts are shuffled once and not sorted.

    Only an hour of more than `chunk` rows has several parts, and where these begin is found
    without texts: one time and number for every `chunk` rows. Rows with the same time and number
    lie in one part."""
    rows = memory.withColumn("hour", C.hour_bucket("time_start"))
    at = F.struct("time_start", "seq")
    full = rows.groupBy("hour").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk).select("hour")
    placed = _positions(rows.select("hour", "time_start", "seq").join(F.broadcast(full), "hour", "left_semi"), limit)
    begins = placed.filter((F.col("pos") > 1) & ((F.col("pos") - 1) % chunk == 0)).groupBy("hour").agg(
        F.collect_list(at).alias("_begins"))
    part = F.size(F.filter(F.coalesce("_begins", F.array().cast("array<struct<time_start:timestamp_ntz,seq:bigint>>")), lambda b: b <= at)).cast("long")
    e = J.sub_event(C.micros("time_start"), "app_name", "text")
    members = rows.join(F.broadcast(begins), "hour", "left").select("hour", part.alias("part"), "seq", e.alias("e"))
    return _packed(members.select("hour", "part", "seq", "e.*"), "t", "seq")


def rollup_week_l2(hours, min_total=5, min_group=3):
    """Week records over hour records (hour, time_start, time_end, preview)."""
    rows = hours.withColumn("week", C.week_bucket("time_start"))
    # Whether there are enough hour records at all: one number.
    enough = not rows.select("hour").limit(min_total).count() < min_total
    heads = rows.groupBy("week").agg(
        F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        F.count(F.lit(1)).alias("count")).filter((F.col("count") >= min_group) & F.lit(enough))
    w = Window.partitionBy("week").orderBy("time_start", "hour")
    # Empty previews count too: each adds a line end, so 301 records fill 300 characters.
    first = (rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= SUMMARY_TEXTS)
             .groupBy("week").agg(F.transform(
                 F.array_sort(F.collect_list(F.struct("_rn", "preview"))),
                 lambda r: r["preview"]).alias("_previews")))
    days = C.div(C.micros("time_end") - C.micros("time_start"), F.lit(C.DAY_US).cast("long"))
    return heads.join(first, "week").select(
        "week", "time_start", "time_end", "count", days.alias("span_days"),
        F.substring(F.array_join("_previews", "\n"), 1, SUMMARY_CHARS).alias("summary"))


def hour_previews(memory):
    """Hour headers with the 200-character preview of their members."""
    rows = memory.withColumn("hour", C.hour_bucket("time_start"))
    heads = rows.groupBy("hour").agg(F.min("time_start").alias("time_start"),
                                     F.max("time_end").alias("time_end"))
    # 101 texts joined by blanks fill 200 characters.
    texts = _first_texts(rows, "hour", ["time_start", "seq"], 200, 101)
    return heads.join(texts, "hour", "left").select(
        "hour", "time_start", "time_end",
        F.coalesce(F.substring(F.array_join("_texts", " "), 1, 200), F.lit("")).alias("preview"))


def event_count(memory):
    """G7."""
    return memory.filter("level = 0").agg(F.count(F.lit(1)).alias("n"))


def storage_estimate(texts, interval_s=3, dim=384, overhead=400, pass_share=5):
    """Bytes per record and projected use, from the mean text length."""
    base = texts.agg(F.count(F.lit(1)).alias("n"),
                     F.floor(F.avg(F.length("text"))).cast("long").alias("avg_chars"))
    theoretical = (8 * 3600) // max(interval_s, 1)
    per_day = max(theoretical // pass_share, 1)
    per_hour = max(per_day // 8, 1)
    record = F.col("avg_chars") + dim * 4 + overhead
    raw, l1 = record * per_day, (F.col("avg_chars") + 100) * (8 * per_hour)
    return base.select(
        "n", "avg_chars", record.alias("record_bytes"), (F.col("n") * record).alias("raw_bytes"),
        F.lit(per_day).cast("long").alias("captures_per_day"), raw.alias("daily_raw_bytes"),
        l1.alias("daily_l1_bytes"), (raw * 7 + l1 * 7).alias("weekly_bytes"))


def last_samples(metrics, keys, n):
    """The newest n samples per key; the rank limit prunes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    return metrics.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latency_stats(metrics, keys=("scope", "metric"), n=100):
    """Integer mean and index-based percentiles of the last n samples."""
    rows = last_samples(metrics, keys, n)
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("ms")).alias("_s"),
                                F.sum("ms").alias("_sum"), F.count(F.lit(1)).alias("n"))

    def at(pct):
        i = F.least(C.div(F.col("n") * pct, F.lit(100).cast("long")), F.col("n") - 1)
        return F.get("_s", i.cast("int"))

    return g.select(*keys, "n", C.div(F.col("_sum"), F.col("n")).alias("avg_ms"),
                    at(95).alias("p95_ms"), at(99).alias("p99_ms"))


def latency_histogram(metrics, keys=("scope", "metric"), n=50):
    """Fast, middle and slow counts of the last n samples."""
    ms = F.col("ms")
    return last_samples(metrics, keys, n).groupBy(*keys).agg(
        F.count_if(ms < 50).alias("fast"), F.count_if((ms >= 50) & (ms < 150)).alias("mid"),
        F.count_if(ms >= 150).alias("slow"), F.count(F.lit(1)).alias("n"))


def link_share(metrics):
    """D3 over store samples: share of rows that extended an earlier one."""
    return metrics.filter(F.col("metric") == "store").groupBy("scope").agg(
        F.count(F.lit(1)).alias("total_frames"), F.count_if(~F.col("is_fresh")).alias("linked"),
        F.round(F.avg((~F.col("is_fresh")).cast("double")) * 100, 1).alias("stability_pct"))


def perf_report(metrics):
    """One row per scope."""
    stats = latency_stats(metrics)
    wide = stats.groupBy("scope").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(f))).alias(f"{m}_{f}")
        for m in ("ocr", "store", "ttft") for f in ("avg_ms", "p95_ms", "p99_ms", "n")])
    hist = latency_histogram(metrics.filter(F.col("metric") == "ocr"), ("scope",))
    return (wide.join(link_share(metrics), "scope", "left")
            .join(hist.drop("n"), "scope", "left"))


def confusion_matrix(cases):
    """Cases with boolean `expect` (should pass) and `got` (passed)."""
    e, g = F.col("expect"), F.col("got")
    return cases.agg(F.count_if(~e & ~g).alias("tp"), F.count_if(e & g).alias("tn"),
                     F.count_if(e & ~g).alias("fp"), F.count_if(~e & g).alias("fn"),
                     F.round(F.avg((e == g).cast("double")), 6).alias("accuracy"))


def probe_pass(answer, must, must_not):
    """At least one required phrase (if any) and no forbidden one."""
    has = (F.size(must) == 0) | F.exists(must, lambda m: answer.contains(m))
    return has & ~F.exists(must_not, lambda m: answer.contains(m))


def tag_counts(tagged, keys=("app_name",)):
    """Rows per tag and key, with a total per tag (NULL key).

    Rows whose key is NULL are counted as any other; of two such rows the total is the larger."""
    counts = tagged.withColumn("tag", F.explode("tags")).groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupingSets([(*keys, "tag"), ("tag",)], *keys, "tag").agg(F.sum("n").alias("n"))
