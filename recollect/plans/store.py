"""Queries: the memory table on disk, its mutations, archive and sinks.

Each job writes a table of its own under the scratch folder and reads it back."""

from pyspark.sql import functions as F

from recollect.functions import payload as J
from recollect.functions import times as C
from recollect.operators import retrieval as RV
from recollect.plans import sql as S
from recollect.plans.registry import query
from recollect.plans.timeline import as_of
from recollect.session import scratch_path
from recollect.sources import store as D
from recollect.sources import views as V

L = F.lit


def fresh_table(spark, d, name):
    """All memory rows, some flagged as stress rows, written as a table."""
    path = scratch_path(spark, name)
    m = V.memory(spark, d, text=True).withColumn("is_stress", F.col("seq") % 10 == 0) \
        .withColumn("app_name", F.when(F.col("seq") % 50 == 1, "stress_long").otherwise(F.col("app_name")))
    D.append(D.stored(m), path)
    return path


def per_date(spark, path):
    return D.read_memory(spark, path).groupBy("level", F.col("date").cast("string").alias("date")).agg(
        F.count(L(1)).alias("n"), F.max("time_start").alias("last_ts"))


def per_date_sql(where):
    return S.with_views("l0", "clock", body=f"""SELECT level, strftime(time_start, '%Y-%m-%d') AS date, count(*) AS n,
     max(time_start) AS last_ts FROM l0, clock WHERE {where} GROUP BY ALL""")


@query("memory_append", per_date_sql("true"))
def memory_append(spark, d):
    return per_date(spark, fresh_table(spark, d, "append"))


@query("add_event", "SELECT ts AS time_start, 'ext:' || event_type AS app_name, 'user ' || user_id AS window_title, props AS text FROM events")
def add_event(spark, d):
    e = V.table(spark, d, "events").select(
        "ts", F.col("props").alias("text"), F.concat(L("ext:"), "event_type").alias("source"),
        F.concat(L("user "), F.col("user_id").cast("string")).alias("event_type"))
    path = scratch_path(spark, "external")
    D.add_events(e, path)
    return D.read_events(spark, path).select("time_start", "app_name", "window_title", "text")


def leveled_table(spark, d):
    """A stored table with rows of levels 0, 1 and 2."""
    path, archive = fresh_table(spark, d, "levels"), scratch_path(spark, "levels-archive")
    embed = lambda t, c: RV.embed_text(t, c)
    D.compact(spark, path, archive, as_of(spark, d), "2024-02-01", embed)
    D.compact_weeks(spark, path, archive, "2024-02-02", embed)
    D.append(D.stored(V.memory(spark, d, text=True)), path)
    return path


@query("stored_level_scan", S.with_views("l0", "clock", ("timed", """SELECT l0.time_start, epoch_us(l0.time_start) // 3600000000 AS hour,
   epoch_us(as_of) // 3600000000 AS open_hour FROM l0, clock"""),
   ("hours", "SELECT hour, min(time_start) AS time_start FROM timed WHERE hour < open_hour GROUP BY 1"),
   ("weeks", "SELECT epoch_us(time_start) // 604800000000 AS week, min(time_start) AS time_start, count(*) AS n FROM hours GROUP BY 1"), body="""
   SELECT 0 AS level, count(*) + count(*) FILTER (hour >= open_hour) AS n, min(time_start) AS first_ts FROM timed
   UNION ALL SELECT 1, count(*), min(h.time_start) FROM hours h JOIN weeks w ON w.week = epoch_us(h.time_start) // 604800000000
     WHERE w.n < 3 HAVING count(*) > 0
   UNION ALL SELECT 2, count(*), min(time_start) FROM weeks WHERE n >= 3"""))
def stored_level_scan(spark, d):
    """S1 over a stored table: one pruned scan for each of the level predicates 0, 1 and >= 1."""
    path = leveled_table(spark, d)
    scan = lambda c: D.read_memory(spark, path).filter(c).groupBy("level").agg(
        F.count(L(1)).alias("n"), F.min("time_start").alias("first_ts"))
    return scan("level = 0").unionByName(scan("level = 1")).unionByName(scan("level >= 1").filter("level > 1"))


@query("forget_recent", per_date_sql("time_start < as_of - INTERVAL 3000 MINUTE"))
def forget_recent(spark, d):
    path = fresh_table(spark, d, "forget")
    D.forget_recent(spark, path, as_of(spark, d), 3000)
    return per_date(spark, path)


@query("wipe_all", "SELECT count(*) AS erased, 0::BIGINT AS left_over FROM events")
def wipe_all(spark, d):
    path = fresh_table(spark, d, "wipe")
    archive = scratch_path(spark, "wiped-archive")
    D.archive_write(D.read_memory(spark, path).filter("level = 0"), archive, "2024-02-01")
    n = D.wipe_all(spark, path, archive)
    return D.read_memory(spark, path).select("id").unionByName(D.archive_read(spark, archive).select("id")).agg(L(n).cast("long").alias("erased"), F.count(L(1)).alias("left_over"))


@query("delete_by_tag", per_date_sql("seq % 10 <> 0 AND seq % 50 <> 1"))
def delete_by_tag(spark, d):
    path = fresh_table(spark, d, "tagged")
    D.delete_by_tag(spark, path)
    return per_date(spark, path)


@query("delete_by_ids", per_date_sql("app_name <> 'clipboard'"))
def delete_by_ids(spark, d):
    path = fresh_table(spark, d, "ids")
    D.delete_by_ids(spark, path, V.memory(spark, d).filter(F.col("app_name") == "clipboard").select("id"))
    return per_date(spark, path)


@query("archive_write", S.with_views("l0", body="SELECT level, count(*) AS n, count(DISTINCT id) AS ids FROM l0 GROUP BY level"))
def archive_write(spark, d):
    path = scratch_path(spark, "archive")
    rows = D.stored(V.memory(spark, d, text=True))
    for _ in range(2):  # the second run must add nothing
        D.archive_write(rows, path, "2024-02-01")
    return D.archive_read(spark, path).groupBy("level").agg(F.count(L(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("archive_read", S.with_views("l0", body="""SELECT level, 2 * count(*) AS n, count(DISTINCT id) AS ids,
   min(time_start) AS first_ts FROM l0 GROUP BY level"""))
def archive_read(spark, d):
    path, old = scratch_path(spark, "archive"), scratch_path(spark, "archive-json")
    rows = D.stored(V.memory(spark, d, text=True))
    D.archive_write(rows, path, "2024-02-01")
    lines = rows.select(F.to_json(F.struct("id", C.micros("time_start").alias("time_start"),
                                           C.micros("time_end").alias("time_end"), "level", "data_json")).alias("value"))
    broken = V.memory(spark, d).select(F.concat(L('{"id":"'), "id").alias("value"))
    lines.unionByName(broken).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(old)
    return D.archive_read(spark, path, old).groupBy("level").agg(
        F.count(L(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("time_start").alias("first_ts"))


@query("compaction_job", S.with_views("l0", "clock", body="""SELECT level, sum(n)::BIGINT AS n, sum(members)::BIGINT AS members FROM (
   SELECT 1 AS level, 1 AS n, count(*) AS members FROM l0, clock WHERE epoch_us(time_start) // 3600000000 < epoch_us(as_of) // 3600000000
     GROUP BY epoch_us(time_start) // 3600000000
   UNION ALL SELECT 0, count(*), 0 FROM l0, clock WHERE epoch_us(time_start) // 3600000000 >= epoch_us(as_of) // 3600000000
   UNION ALL SELECT 9, 0, count(*) FROM l0, clock WHERE epoch_us(time_start) // 3600000000 < epoch_us(as_of) // 3600000000) GROUP BY level"""))
def compaction_job(spark, d):
    path, archive = fresh_table(spark, d, "compact"), scratch_path(spark, "compact-archive")
    D.compact(spark, path, archive, as_of(spark, d), "2024-02-01", lambda t, c: RV.embed_text(t, c))
    v = J.parsed("data_json")
    members = F.coalesce(F.try_variant_get(v, "$.count", "bigint"), L(0).cast("long"))
    table = D.read_memory(spark, path).groupBy("level").agg(F.count(L(1)).alias("n"), F.sum(members).alias("members"))
    return table.unionByName(D.archive_read(spark, archive).agg(
        L(9).alias("level"), L(0).cast("long").alias("n"), F.count(L(1)).alias("members")))


@query("week_compaction_job", S.with_views("l0t", "clock", ("hours", """SELECT epoch_us(l0t.time_start) // 3600000000 AS hour,
   min(l0t.time_start) AS time_start, max(l0t.time_end) AS time_end,
   left(coalesce(string_agg(text, ' ' ORDER BY l0t.time_start, seq) FILTER (text <> ''), ''), 200) AS preview
   FROM l0t, clock WHERE epoch_us(l0t.time_start) // 3600000000 < epoch_us(as_of) // 3600000000 GROUP BY 1"""), ("weeks", """
   SELECT epoch_us(h.time_start) // 604800000000 AS week, min(h.time_start) AS time_start, max(h.time_end) AS time_end, count(*) AS count,
     (epoch_us(max(h.time_end)) - epoch_us(min(h.time_start))) // 86400000000 AS span_days,
     md5(left(string_agg(preview, chr(10) ORDER BY h.time_start, hour), 300)) AS summary
   FROM hours h GROUP BY 1 HAVING count(*) >= 3 AND (SELECT count(*) FROM hours) >= 5"""), body="""
   SELECT w.*, (SELECT count(*) FROM hours) - (SELECT sum(count) FROM weeks) AS hours_left, (SELECT sum(count) FROM weeks) AS hours_archived
   FROM weeks w"""))
def week_compaction_job(spark, d):
    """Both levels of compaction over a stored table; the week records as they stand there."""
    path, archive = fresh_table(spark, d, "weeks"), scratch_path(spark, "weeks-archive")
    embed = lambda t, c: RV.embed_text(t, c)
    D.compact(spark, path, archive, as_of(spark, d), "2024-02-01", embed)
    D.compact_weeks(spark, path, archive, "2024-02-02", embed)
    v = J.parsed("data_json")
    left = D.read_memory(spark, path).agg(F.count_if(F.col("level") == 1).alias("hours_left"))
    kept = D.archive_read(spark, archive).agg(F.count_if(F.col("level") == 1).alias("hours_archived"))
    weeks = D.read_memory(spark, path).filter("level = 2").select(
        C.week_bucket("time_start").alias("week"), "time_start", "time_end",
        *[F.try_variant_get(v, f"$.{c}", "bigint").alias(c) for c in ("count", "span_days")],
        F.md5(F.try_variant_get(v, "$.summary", "string")).alias("summary"))
    return weeks.crossJoin(F.broadcast(left)).crossJoin(F.broadcast(kept))  # one row each


@query("storage_usage")
def storage_usage(spark, d):
    return D.storage_usage(spark, d)


def token_lines(spark, d):
    """Assistant texts as a stream of token lines; every second one stops early."""
    c = V.table(spark, d, "conversations").filter(F.col("role") == "assistant")
    toks = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("stream_id"),
                    F.posexplode(F.split("text", " ")).alias("seq", "tok"))
    stop = (F.col("seq") == 12) & (F.col("stream_id") % 2 == 0)
    body = F.to_json(F.struct(F.concat(F.col("tok"), L(" ")).alias("content"), stop.alias("stop")))
    line = F.when(F.col("seq") % 9 == 4, L('data: {"content":7,"stop":"no"}')).when(
        F.col("seq") % 9 == 5, L("data: {broken")).when(F.col("seq") % 2 == 0, F.concat(L("data: "), body)).otherwise(body)
    return toks.select("stream_id", F.col("seq").cast("bigint").alias("seq"), line.alias("line"))


@query("token_stream_decode", """SELECT stream_id, md5(string_agg(tok || ' ', '' ORDER BY seq)) AS text FROM (
   SELECT conv_id * 100 + turn AS stream_id, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) - 1 AS seq
   FROM conversations WHERE role = 'assistant') WHERE seq % 9 NOT IN (4, 5) AND NOT (stream_id % 2 = 0 AND seq > 12) GROUP BY stream_id""")
def token_stream_decode(spark, d):
    return D.token_stream_decode(token_lines(spark, d)).select("stream_id", F.md5("text").alias("text"))


@query("notes_sink", """SELECT 'src ' || source AS stem, rn AS pos, md5(CASE WHEN rn = 1 THEN '# src:' || source || '?' || chr(10) || stamp || chr(10) || chr(10) || text || chr(10)
   ELSE chr(10) || chr(10) || '---' || chr(10) || stamp || chr(10) || text || chr(10) END) AS section FROM (
   SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn,
     '_' || strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id), '%Y-%m-%d %H:%M') || '_' AS stamp FROM documents)""")
def notes_sink(spark, d):
    """Two batches: the later half is added to the documents of the first."""
    docs = V.documents(spark, d)
    at = C.from_micros(C.micros(L("2024-01-01 00:00:00").cast("timestamp_ntz")) + F.col("doc_id") * 60_000_000)
    notes = docs.select(F.concat(L("src:"), "source", L("?")).alias("title"), at.alias("ts"),
                        F.col("doc_id").alias("seq"), F.col("text").alias("body"))
    half = docs.agg(F.max("doc_id")).first()[0] // 2
    path = scratch_path(spark, "notes")
    D.append_notes(notes.filter(F.col("seq") <= half), path)
    D.append_notes(notes.filter(F.col("seq") > half), path)
    return D.read_notes(spark, path).select("stem", "pos", F.md5("section").alias("section"))
