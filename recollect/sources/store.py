"""The memory table on disk: append, forget, archive, compact, export."""

import uuid
from datetime import date
from itertools import groupby

from pyspark.sql import functions as F

from recollect.functions import payload as J
from recollect.functions import privacy as R
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators import rollup as G
from recollect.operators.ordered import HOT_ROWS, Ordered
from recollect.operators.timeline import newest
from recollect.schema import ARCHIVE, MEMORY
from recollect.session import release, written
from recollect.sources import changes
from recollect.sources.changes import entries, file_of, folder, recover, rewrite

PARTS = ["level", "date"]
PORTION = 64 << 20  # bytes of stored rows that a compaction takes on at a time, or
PORTIONS = 8        # this share of them all, if that is more


def opened(rows, key):
    """Rows with readable contents; without a key they stay as they are stored."""
    return rows if key is None else rows.withColumn("data_json", R.open_sealed("data_json", F.lit(key)))


def sealed(rows, key):
    """R10 at rest: contents sealed where a key is given."""
    return rows if key is None else rows.withColumn("data_json", R.seal("data_json", F.lit(key)))


def read_memory(spark, path, key=None):
    return opened(spark.read.schema(MEMORY).parquet(path), key)


def append(rows, path, key=None, run=None):
    """S3: add whole batches of records, partitioned by level and date.

    run: (name, number) of a batch whose repetition must change nothing; the numbers of a
    name rise."""
    out = rows.withColumn("date", F.to_date("time_start")).select(*[f.name for f in MEMORY.fields])
    out = sealed(out, key)
    if run:
        return changes.append_once(out, path, *run, PARTS)
    changes.place(out, path, PARTS, "append")
    return True


def sink(path, run, key=None):
    """For `foreachBatch`: every batch of a stream enters the table exactly once. A run
    belongs to one checkpoint of the stream."""
    def save(batch, number):
        append(batch, path, key, (run, number))
    return save


def stored(memory):
    """Level-0 records of memory rows (with text and, if present, vectors)."""
    body = F.struct(
        "app_name", "window_title", "text", F.array().cast("array<string>").alias("tags"),
        F.array().cast(f"array<{J.DELTA}>").alias("deltas"),
        (F.col("is_stress") if "is_stress" in memory.columns else F.lit(False)).alias("is_stress"))
    vec = F.col("embedding") if "embedding" in memory.columns else F.array().cast("array<float>")
    return memory.select("id", "time_start", "time_end", "level", "archived",
                         F.to_json(body).alias("data_json"), vec.alias("embedding"))


def add_event(events):
    """External events (ts, text, source, event_type) as memory rows.

    The id is a digest of the event, so a retried write gives the same row."""
    ident = F.md5(F.concat_ws("\x1f", F.col("ts").cast("string"), "source", "event_type", "text"))
    return events.select(
        ident.alias("id"), F.col("ts").alias("time_start"), F.col("ts").alias("time_end"),
        F.lit(0).alias("level"), F.lit(False).alias("archived"),
        F.col("source").alias("app_name"), F.col("event_type").alias("window_title"), "text")


def add_events(events, path, key=None, run=None):
    """External events into the table."""
    return append(stored(add_event(events)), path, key, run)


def read_events(spark, path, level=0, key=None):
    """The rows of a level with their app, title and text as columns; only the files of that
    level are read."""
    v = J.parsed("data_json")
    return read_memory(spark, path, key).filter(F.col("level") == level).select(
        "id", "time_start", "time_end", "level", "date", J.string_field(v, "app_name").alias("app_name"),
        J.string_field(v, "window_title").alias("window_title"), J.string_field(v, "text").alias("text"))


# --- deletion ------------------------------------------------------------------

def has_rows(spark, path):
    """Whether a folder holds partitions or files yet."""
    return any(not name.startswith("_") for name in entries(spark, path))


def _delete(spark, path, count, keep):
    """Rewrite the files that hold doomed rows; returns the number of these rows.

    count: (_file, n) of the doomed rows of the table. The kept rows of those files are written
    first and then replace just the files that were read: rows that others append meanwhile are in
    files of their own and stay. A failed job leaves the table as it was or is ended by the next
    change (see `changes`)."""
    hit = count.collect()  # one row per file that changes
    if not hit:
        return 0

    def kept(files):
        rows = spark.read.schema(MEMORY).option("basePath", path).parquet(*files)
        return keep(rows).select(*[f.name for f in MEMORY.fields])

    rewrite(spark, path, uuid.uuid4().hex, PARTS, [r["_file"] for r in hit], kept)
    return sum(r["n"] for r in hit)


def _delete_where(spark, path, doomed):
    doomed = F.coalesce(doomed, F.lit(False))  # a row that cannot be judged stays
    recover(spark, path)
    hit = read_memory(spark, path).withColumn("_file", file_of()).filter(doomed).groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
    return _delete(spark, path, hit, lambda t: t.filter(~doomed))


def forget_recent(spark, path, as_of, minutes=15):
    """M1: delete level-0 rows that began in the last `minutes`."""
    since = C.from_micros(C.micros(as_of) - F.lit(minutes * 60_000_000).cast("long"))
    doomed = (F.col("level") == 0) & (F.col("date") >= F.to_date(since)) & (F.col("time_start") >= since)
    return _delete_where(spark, path, doomed)


def wipe_all(spark, path, archive=None):
    """M2: delete every row of the table and of its archive; returns the table's row count."""
    recover(spark, path)
    n = read_memory(spark, path).count()
    for root in [path] + ([archive] if archive else []):
        for name in entries(spark, root):
            if name != changes.DONE:  # batches that were added stay known
                fs, entry = folder(spark, f"{root}/{name}")
                fs.delete(entry, True)
    return n


def delete_by_tag(spark, path, app="stress_long", key=None):
    """M3: delete level-0 rows of a test app or flagged as a stress row."""
    v = J.parsed("data_json" if key is None else R.open_sealed("data_json", F.lit(key)))
    hit = (F.col("level") == 0) & (
        F.coalesce(J.string_field(v, "app_name") == app, F.lit(False))
        | F.coalesce(F.try_variant_get(v, "$.is_stress", "boolean"), F.lit(False)))
    return _delete_where(spark, path, hit)


def delete_by_ids(spark, path, ids, where=None):
    """M4: delete the rows whose id is listed. The join with the ids finds places; contents are
    not shuffled. where: only among the rows of these partitions."""
    recover(spark, path)
    table = read_memory(spark, path)
    marks = changes.marks_of(table if where is None else table.filter(where), ids)
    return _delete(spark, path, marks.groupBy("_file").agg(F.sum(F.bitmap_count("_bits")).alias("n")),
                   lambda t: changes.split(t, marks, False))


# --- archive -------------------------------------------------------------------

def archived_ids(spark, path, day):
    """The ids in the archive of a day, as it is now."""
    if not has_rows(spark, path):
        return spark.createDataFrame([], "id string")
    return archive_read(spark, path).filter(F.col("archive_date") == F.lit(day).cast("date")).select("id")


def archive_write(rows, path, day, key=None, known=None):
    """Add rows to the archive of a day, compressed; rows already there (by
    id) are not written twice, so a repeated run is harmless. With a key, contents
    are sealed. known: the `archived_ids` from before a run that writes in portions, so that
    rows of its own are not taken for earlier ones."""
    spark = rows.sparkSession
    rows = sealed(rows, key)
    out = rows.select(*[f.name for f in ARCHIVE.fields if f.name != "archive_date"]).withColumn(
        "archive_date", F.lit(day).cast("date"))
    if has_rows(spark, path):
        # Ids alone tell whether all, none or some of the rows are new; only some need the join.
        old = archived_ids(spark, path, day) if known is None else known
        if rows.select("id").join(old, "id", "left_anti").isEmpty():
            return
        if not rows.select("id").join(old, "id", "left_semi").isEmpty():
            out = out.join(old, "id", "left_anti")
    changes.place(out, path, ["archive_date", "level"], "append")


def archive_read(spark, path, json_path=None, key=None):
    """The archive; older JSON-lines files are added, their broken lines skipped."""
    out = spark.read.schema(ARCHIVE).parquet(path)
    if json_path:
        lines = spark.read.schema("id string, time_start bigint, time_end bigint, level int, data_json string") \
            .option("mode", "DROPMALFORMED").json(json_path)
        out = out.unionByName(lines.filter(F.col("id").isNotNull()).select(
            "id", C.from_micros(F.col("time_start")).alias("time_start"),
            C.from_micros(F.col("time_end")).alias("time_end"), "level", "data_json",
            F.lit(None).cast("date").alias("archive_date")))
    return opened(out, key)


# --- compaction ----------------------------------------------------------------

def hour_records(memory_rows, embed, limit=HOT_ROWS):
    """Level-1 records of level-0 table rows; very full hours take several rows.

    embed: adds `embedding` from the text column it is given. A record's id holds a
    digest of the hour's members, so other members give another record."""
    v = J.parsed("data_json")
    rows = memory_rows.withColumns({
        "app_name": F.coalesce(J.string_field(v, "app_name"), F.lit("screen")),
        "text": F.coalesce(J.string_field(v, "text"), F.lit("")),
        "seq": F.xxhash64("id"), "hour": C.hour_bucket("time_start")})
    digest = rows.groupBy("hour").agg(F.hex(F.bit_xor(F.xxhash64("id"))).alias("members"))
    parts = G.hour_records(rows, limit=limit)
    heads = G.rollup_hour_l1(rows)
    # One row per hour goes to the records, which hold all texts.
    out = embed(parts.join(F.broadcast(heads.drop("count")), "hour").join(F.broadcast(digest), "hour"), "embed_text")
    return out.select(
        F.concat_ws("-", F.concat(F.lit("h"), F.col("hour")), "part", "members").alias("id"),
        "time_start", "time_end", F.lit(1).alias("level"), F.lit(False).alias("archived"), "data_json", "embedding")


def week_records(hour_rows, embed):
    """Level-2 records of level-1 table rows. A record's id holds a digest of the week's
    members, so other members give another record."""
    v = J.parsed("data_json")
    rows = hour_rows.select("id", "time_start", "time_end", F.col("id").alias("hour"),
                            J.text_preview("data_json", v).alias("preview"))
    digest = rows.groupBy(C.week_bucket("time_start").alias("week")).agg(F.hex(F.bit_xor(F.xxhash64("id"))).alias("members"))
    heads = G.rollup_week_l2(rows, 1, 1).join(digest, "week")
    out = embed(heads.withColumn("_text", F.concat(F.lit("Topic node: "), "summary")), "_text")
    return out.select(
        F.concat_ws("-", F.concat(F.lit("w"), F.col("week")), "members").alias("id"), "time_start", "time_end",
        F.lit(2).alias("level"), F.lit(False).alias("archived"),
        F.to_json(F.struct("summary", "span_days", "count")).alias("data_json"), "embedding")


def _roll_up(spark, path, rows, records, level, key, where):
    """Records of archived rows that the table still holds, then those rows go.

    rows: from files of the table as they were listed, so later files are not among them, and from
    the partitions `where`."""
    there = read_memory(spark, path).filter(F.col("level") == level).select("id")  # a row per record of many rows
    append(sealed(records(opened(rows, key)), key).join(F.broadcast(there), "id", "left_anti"), path)
    release(spark)  # the shuffled texts
    return delete_by_ids(spark, path, rows, where)


def _portions(spark, path, rows, level, span):
    """[(rows, where)]: the rows of a level in portions of whole partitions. Texts lie on the disk
    several times while they are rolled up, and only those of one portion do.

    span: days whose rows make one record."""
    days = sorted((r["date"] for r in rows.select("date").distinct().collect()), key=lambda d: d or date.min)  # a row a day
    # Buckets of time are rounded towards 1970, so the days before it are not parted.
    spans = [list(g) for _, g in groupby(days, lambda d: d and max((d - date(1970, 1, 1)).days, 0) // span)]
    held = [sum(changes.size_of(spark, f"{path}/level={level}/date={d or changes.NO_VALUE}") for d in g) for g in spans]
    most, out, size = max(PORTION, sum(held) // PORTIONS), [[]], 0
    for g, n in zip(spans, held):
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1] += g
        size += n
    here = lambda g: F.when(F.col("date").isNull(), None in g).otherwise(F.col("date").isin([d for d in g if d]))
    return [(rows.filter(here(g)), (F.col("level") == level) & here(g)) for g in out]


def _compact(spark, path, archive, chosen, level, records, run_day, key, span=1):
    """Roll rows of a level up to the next, archive them, then delete them, a portion after the other.

    chosen: the rows of the level to take on, from the table as it is then. The archive says
    which rows a run has taken on. Rows that an earlier run archived but did not finish come
    first, on their own, with the same members and so the same record ids."""
    recover(spark, path)
    done = 0
    if has_rows(spark, archive):
        taken = archive_read(spark, archive).filter(F.col("level") == level).select("id").distinct()
        table = read_memory(spark, path).filter(F.col("level") == level)
        marks = changes.marks_of(table, taken)
        if not marks.isEmpty():
            for rows, where in _portions(spark, path, changes.split(table, marks, True), level, span):
                done += _roll_up(spark, path, rows, records, level + 1, key, where)
    source = chosen(read_memory(spark, path).filter(F.col("level") == level))
    if source is None:
        return done
    known = archived_ids(spark, archive, run_day)
    for rows, where in _portions(spark, path, source, level, span):
        archive_write(rows, archive, run_day, None, known)
        done += _roll_up(spark, path, rows, records, level + 1, key, where)
    return done


def compact(spark, path, archive, as_of, run_day, embed, include_open=False, key=None):
    """Roll closed hours up to level 1, archive their rows, then delete them.

    Rows that arrive at any moment, for hours compacted before or during the run, are not
    among the ids that are deleted; the next run gives them a record of their own. With a
    key, rows are opened only to make records, and nothing is written open."""
    open_hour = C.from_micros(C.hour_bucket(as_of) * C.HOUR_US)

    def closed(rows):
        if include_open:
            return rows
        return rows.filter((F.col("date") <= F.to_date(open_hour)) & (F.col("time_start") < open_hour))

    return _compact(spark, path, archive, closed, 0, lambda rows: hour_records(rows, embed), run_day, key)


def compact_weeks(spark, path, archive, run_day, embed, min_total=5, min_group=3, key=None):
    """Roll hour records up to level 2, archive them, then delete them.

    A table of fewer than `min_total` hour records stays as it is, and so does a week of
    fewer than `min_group`. Archived hour records lie in the level-1 partitions of the day."""
    def full(rows):
        if rows.limit(min_total).count() < min_total:
            return None
        week = C.week_bucket("time_start").alias("week")
        # Written: a later portion would look for files that an earlier one has replaced.
        weeks = written(rows.groupBy(week).count().filter(F.col("count") >= min_group).select("week"), "full-weeks")
        return rows.withColumn("week", week).join(F.broadcast(weeks), "week", "left_semi").drop("week")

    return _compact(spark, path, archive, full, 1, lambda rows: week_records(rows, embed), run_day, key, 7)


# --- sources and sinks around the table ------------------------------------------

def export_recent(memory, n=1000):
    """The newest n rows as JSON lines."""
    line = F.to_json(F.struct(
        "id", C.fmt_ts("time_start").alias("time_start"), C.fmt_ts("time_end").alias("time_end"),
        C.micros("time_start").alias("timestamp_us"),
        F.struct("app_name", "window_title", "text").alias("data")))
    return newest(memory, n).select(line.alias("line"))


def storage_usage(spark, path):
    """Files and bytes under a folder (contents are not read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("length"))
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def token_stream_decode(lines, chunk=10_000, limit=HOT_ROWS):
    """The text of each token stream (stream_id, seq, line) up to its first stop.

    Joined in two levels, so that no task gathers more than a chunk of tokens
    before they are one piece of text."""
    v = F.try_parse_json(F.regexp_replace("line", r"\Adata: ", ""))
    rows = lines.withColumn("_v", v).filter(F.col("_v").isNotNull())
    rows = rows.select("stream_id", "seq", F.coalesce(J.string_field(F.col("_v"), "content"), F.lit("")).alias("tok"),
                       F.coalesce(F.when(F.schema_of_variant(F.try_variant_get("_v", "$.stop", "variant")) == "BOOLEAN",
                                         F.try_variant_get("_v", "$.stop", "boolean")), F.lit(False)).alias("stop"))
    o = Ordered(rows, ["stream_id"], ["seq"], F.col("seq"), limit, grain=1)
    o.running_sum(F.col("stop").cast("int"), "_stops")
    o.running_sum(F.lit(1), "_pos")
    live = o.result().filter((F.col("_stops") == 0) | ((F.col("_stops") == 1) & F.col("stop")))

    def joined(key, value):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))),
                                        lambda r: r[value]), "")

    parts = live.groupBy("stream_id", C.div(F.col("_pos"), F.lit(chunk).cast("long")).alias("_part")).agg(
        joined("seq", "tok").alias("_text"))
    return parts.groupBy("stream_id").agg(joined("_part", "_text").alias("text"))


def note_sections(notes, before=None, limit=HOT_ROWS):
    """Notes (title, ts, seq, body) as ordered sections of one document per
    safe title.  A document is its sections in order; a popular title may have
    any number of them, so they stay rows.

    before: (stem, pos), the last section of each document that exists already."""
    rows = notes.withColumn("stem", T.sanitize_stem("title"))
    o = Ordered(rows, ["stem"], ["ts", "seq"], C.micros("ts"), limit)
    o.running_sum(F.lit(1), "pos")
    rows = o.result()
    if before is not None:
        rows = rows.join(before.select("stem", F.col("pos").alias("_had")), "stem", "left").withColumn(
            "pos", F.col("pos") + F.coalesce("_had", F.lit(0)))
    stamp = F.concat(F.lit("_"), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("_"))
    section = F.when(F.col("pos") == 1, F.concat(F.lit("# "), "title", F.lit("\n"), stamp, F.lit("\n\n"), "body", F.lit("\n"))) \
        .otherwise(F.concat(F.lit("\n\n---\n"), stamp, F.lit("\n"), "body", F.lit("\n")))
    return rows.select("stem", "pos", section.alias("section"))


NOTES = "stem string, pos bigint, section string"


def append_notes(notes, path):
    """Add notes to the documents of a folder, after the sections they have."""
    spark = notes.sparkSession
    before = None
    if has_rows(spark, path):
        before = read_notes(spark, path).groupBy("stem").agg(F.max("pos").alias("pos"))
    note_sections(notes, before).write.mode("append").parquet(path)


def read_notes(spark, path):
    return spark.read.schema(NOTES).parquet(path)
