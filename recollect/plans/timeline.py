"""Queries: scans, timeline, ranking and aggregation."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import times as C
from recollect.operators import rollup as G
from recollect.operators import timeline as W
from recollect.plans import sql as S
from recollect.plans.registry import query
from recollect.sources import views as V


def as_of(spark, sf_dir):
    """The newest event time: one value, read once."""
    return F.lit(V.table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


ACTIVITY = ("activity", "SELECT * FROM l0 WHERE app_name NOT IN ('clipboard', 'system', 'user', "
            "'dialogue', 'qa', 'note')")
PHRASES = S.phrase_views("activity")
KEPT = ("kept", """SELECT * FROM (SELECT *, lag(phrase) OVER (ORDER BY time_start DESC, seq DESC) AS newer
   FROM phrases) WHERE newer IS NULL OR newer <> phrase""")
LINE = ("strftime(time_start, '%H:%M') || ' (' || " + S.rel_age("time_start", "as_of")
        + " || ') — ' || phrase")


@query("memory_scan_level", S.with_views("l0", body="""SELECT stream, level, count(*) AS n,
   min(time_start) AS first_ts, max(time_start) AS last_ts FROM l0 WHERE level = 0 GROUP BY ALL"""))
def memory_scan_level(spark, d):
    return V.memory(spark, d).filter("level = 0").groupBy("stream", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("time_start").alias("first_ts"),
        F.max("time_start").alias("last_ts"))


@query("context_scan", S.with_views("l0", body="""SELECT id, time_start AS ts, app_name, window_title
   FROM l0 WHERE level = 0"""))
def context_scan(spark, d):
    return V.memory(spark, d).filter("level = 0").select(
        "id", F.col("time_start").alias("ts"), "app_name", "window_title")


@query("export_recent", S.with_views("l0t", body=f"""SELECT id, {S.fmt_ts('time_start')} AS start_text,
   {S.fmt_ts('time_end')} AS end_text, epoch_us(time_start) AS timestamp_us, app_name, text
   FROM l0t ORDER BY time_start DESC, seq DESC LIMIT 1000"""))
def export_recent(spark, d):
    from recollect.sources.store import export_recent as job
    line = "id string, time_start string, time_end string, timestamp_us bigint, data struct<app_name:string,text:string>"
    out = job(V.memory(spark, d, text=True), 1000).select(F.from_json("line", line).alias("j"))
    return out.select("j.id", F.col("j.time_start").alias("start_text"),
                      F.col("j.time_end").alias("end_text"), "j.timestamp_us",
                      "j.data.app_name", "j.data.text")


@query("last_screen_snapshot", S.with_views("l0t", body=f"""SELECT {S.fmt_ts('time_start')} AS at, text FROM l0t
   WHERE app_name NOT IN ('clipboard', 'system', 'user') ORDER BY time_start DESC, seq DESC LIMIT 1"""))
def last_screen_snapshot(spark, d):
    return W.last_screen_snapshot(V.memory(spark, d, text=True)).select(
        C.fmt_ts("time_start").alias("at"), "text")


@query("last_n_screen_facts", S.with_views("l0t", body=f"""SELECT {S.fmt_ts('time_start')} AS at, text FROM l0t
   WHERE app_name NOT IN ('clipboard', 'system', 'user') ORDER BY time_start DESC, seq DESC LIMIT 25"""))
def last_n_screen_facts(spark, d):
    return W.last_n_screen_facts(V.memory(spark, d, text=True), 25).select(
        C.fmt_ts("time_start").alias("at"), "text")


@query("recent_qa", S.with_views("l0t", body=f"""SELECT {S.fmt_ts('time_start')} AS at, text FROM l0t
   WHERE app_name = 'dialogue' ORDER BY time_start DESC, seq DESC LIMIT 20"""))
def recent_qa(spark, d):
    return W.recent_qa(V.memory(spark, d, text=True), 20).select(
        C.fmt_ts("time_start").alias("at"), "text")


@query("activity_feed", S.with_views("l0", ACTIVITY, body="SELECT id, time_start, app_name, window_title FROM activity"))
def activity_feed(spark, d):
    return W.activity_feed(V.memory(spark, d)).select("id", "time_start", "app_name", "window_title")


@query("collapse_consecutive", S.with_views("l0", ACTIVITY, *PHRASES, KEPT, body="""SELECT category, count(*) AS kept,
   count(DISTINCT phrase) AS phrases FROM kept GROUP BY ALL"""))
def collapse_consecutive(spark, d):
    rows = W.collapse_consecutive(W.with_phrases(W.activity_feed(V.memory(spark, d))))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("kept"),
                                        F.countDistinct("phrase").alias("phrases"))


@query("iron_log", S.with_views("l0", "clock", ACTIVITY, *PHRASES, KEPT, body=f"""SELECT time_start, {LINE} AS line
   FROM kept  , clock ORDER BY time_start DESC, seq DESC LIMIT 50"""))
def iron_log(spark, d):
    return W.iron_log(V.memory(spark, d), 50, as_of(spark, d)).select("time_start", "line")


@query("top_categories", S.with_views("l0", "clock", ACTIVITY, *PHRASES, KEPT, (
    "newest", "SELECT * FROM kept ORDER BY time_start DESC, seq DESC LIMIT 50"), body="""
   SELECT string_agg(category, ' and ' ORDER BY t DESC) AS acts FROM (
     SELECT category, max(time_start) AS t FROM newest GROUP BY 1 ORDER BY t DESC LIMIT 2)"""))
def top_categories(spark, d):
    return W.top_categories(W.iron_log(V.memory(spark, d), 50, as_of(spark, d)))


@query("activity_summary", S.with_views("l0", "clock", ACTIVITY, *PHRASES, KEPT, (
    "newest", "SELECT * FROM kept ORDER BY time_start DESC, seq DESC LIMIT 6"), body=f"""
   SELECT 'Today you ' || (SELECT string_agg(category, ' and ' ORDER BY t DESC) FROM (
     SELECT category, max(time_start) AS t FROM newest GROUP BY 1 ORDER BY t DESC LIMIT 2))
     || '. Timeline:' || chr(10) || (SELECT string_agg('• ' || {LINE}, chr(10)
        ORDER BY time_start DESC, seq DESC) FROM newest  , clock) AS summary"""))
def activity_summary(spark, d):
    return W.activity_summary(V.memory(spark, d), 6, as_of(spark, d))


SERVICE_VALUES = ", ".join(
    f"({i}, {S.lit(sid)}, {S.lit(kind)}, {S.lit(a)})"
    for i, (sid, _, kind, aliases) in enumerate(rules.SERVICES) for a in aliases)
SERVICES = ("services", f"SELECT * FROM (VALUES {SERVICE_VALUES}) AS t(pos, service, kind, alias)")
HITS = ("hits", """SELECT DISTINCT a.id, a.seq, a.stream, a.time_start, s.pos, s.service, s.kind
   FROM activity a JOIN services s ON contains(lower(a.app_name || ' ' || a.window_title), s.alias)""")


@query("service_alias_join", S.with_views("l0", ACTIVITY, SERVICES, HITS, body="""SELECT service, stream,
   count(*) AS n FROM hits GROUP BY ALL"""))
def service_alias_join(spark, d):
    hits = W.service_alias_join(W.activity_feed(V.memory(spark, d)))
    return hits.groupBy("service", "stream").agg(F.count(F.lit(1)).alias("n"))


@query("preferred_service", S.with_views("l0", ACTIVITY, SERVICES, HITS, ("ranked", """SELECT id,
   row_number() OVER (PARTITION BY stream ORDER BY time_start DESC, seq DESC) AS rn FROM activity"""),
    ("scored", """SELECT stream, pos, service, kind, round(sum(1.0::DOUBLE / (1.0 + (rn - 1) * 0.03::DOUBLE)), 9) AS score
   FROM hits JOIN ranked USING (id) WHERE rn <= 300 AND kind IN ('audio', 'both') GROUP BY ALL"""),
    body="""SELECT stream, service, score FROM scored QUALIFY row_number() OVER (PARTITION BY stream
   ORDER BY (kind = 'audio') DESC, score DESC, pos) = 1"""))
def preferred_service(spark, d):
    return W.preferred_service(W.activity_feed(V.memory(spark, d)), "audio")


@query("most_recent_service", S.with_views("l0", ACTIVITY, SERVICES, HITS, body="""SELECT stream, service FROM hits
   QUALIFY row_number() OVER (PARTITION BY stream ORDER BY time_start DESC, seq DESC, pos) = 1"""))
def most_recent_service(spark, d):
    return W.most_recent_service(W.activity_feed(V.memory(spark, d)))


@query("service_alias_table", S.with_views("l0", ACTIVITY, SERVICES, HITS, body="""SELECT service, stream,
   count(*) AS n FROM hits GROUP BY ALL"""))
def service_alias_table(spark, d):
    """The same join with the aliases as a table."""
    hits = W.service_alias_join(W.activity_feed(V.memory(spark, d)), W.service_dimension(spark))
    return hits.groupBy("service", "stream").agg(F.count(F.lit(1)).alias("n"))


@query("alias_table_hits", S.with_views(("aliases", """SELECT source AS service, lang AS kind, lower(w) AS alias FROM (
   SELECT source, lang, unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) BETWEEN 5 AND 12 GROUP BY ALL"""),
   ("hay", "SELECT conv_id, turn, lower(text) AS hay FROM conversations"),
   ("words", "SELECT DISTINCT alias FROM aliases"),
   ("met", "SELECT h.conv_id, h.turn, w.alias FROM hay h JOIN words w ON contains(h.hay, w.alias)"), body="""
   SELECT service, kind, count(*) AS n FROM (SELECT DISTINCT conv_id, turn, service, kind FROM met JOIN aliases USING (alias)) GROUP BY ALL"""))
def alias_table_hits(spark, d):
    """A table of aliases made of all words of the documents, met with every turn."""
    docs = V.documents(spark, d).select("source", "lang", F.explode(F.split("text", " ")).alias("w"))
    words = docs.filter(F.length("w").between(5, 12)).select(
        F.lit(0).alias("pos"), F.col("source").alias("service"), F.lit("").alias("label"), F.col("lang").alias("kind"),
        F.lower("w").alias("alias")).distinct()
    hits = W.alias_hits(V.table(spark, d, "conversations").select("conv_id", "turn", "text"), F.lower("text"), words)
    return hits.groupBy("service", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("sessions", S.with_views("l0", ("marked", """SELECT *, CASE WHEN time_start - lag(time_start) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
   FROM l0 WINDOW w AS (PARTITION BY stream ORDER BY time_start, seq)"""), ("numbered", """SELECT *, sum(fresh) OVER (PARTITION BY stream
   ORDER BY time_start, seq) AS session FROM marked"""), body="""SELECT stream, min(time_start) AS first_ts, max(time_start) AS last_ts, count(*) AS n
   FROM numbered GROUP BY stream, session"""))
def sessions(spark, d):
    return W.sessions(V.memory(spark, d))


@query("history_messages", S.with_views("qa", body=f"""SELECT ts, role, message FROM (SELECT * FROM (
     SELECT ts, unnest([0, 1]) AS pos, unnest(['user', 'ai']) AS role,
     unnest([{S.trim('question')}, {S.trim('answer')}]) AS message FROM (
       SELECT * FROM qa ORDER BY ts DESC, conv_id DESC LIMIT 20))) WHERE message <> ''"""))
def history_messages(spark, d):
    qa = V.qa_pairs(spark, d)
    stored = qa.select(F.col("ts").alias("time_start"), F.col("conv_id").alias("seq"),
                       F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("text"))
    return W.history_messages(stored, 20).select(F.col("time_start").alias("ts"), "role", "message")


def reminders(spark, d):
    """Reminder markers written by a monitor: one per event, text by app."""
    m = V.memory(spark, d)
    reply = F.when(F.col("seq") % 5 == 0, F.lit("IDLE")).otherwise(F.concat(
        F.lit('ok [ACTION: REMIND(" call '), "app_name", F.lit(' ")] end')))
    return m.select(F.to_date("time_start").cast("string").alias("day"),
                    F.col("time_start").alias("ts"), "seq", reply.alias("reply"))


REMIND = ("reminders", """SELECT strftime(time_start, '%Y-%m-%d') AS day, time_start AS ts, seq,
   'call ' || app_name AS reminder FROM l0 WHERE seq % 5 <> 0""")


@query("parse_reminder", S.with_views("l0", REMIND, body="SELECT day, reminder, count(*) AS n FROM reminders GROUP BY ALL"))
def parse_reminder(spark, d):
    r = reminders(spark, d).withColumn("reminder", K.parse_reminder("reply"))
    return r.filter(F.col("reminder").isNotNull()).groupBy("day", "reminder").agg(
        F.count(F.lit(1)).alias("n"))


@query("daily_reminder_cap", S.with_views("l0", REMIND, body="""SELECT day, reminder, ts, rank FROM (
   SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, seq) AS rank FROM (
     SELECT * FROM reminders QUALIFY row_number() OVER (PARTITION BY day, reminder ORDER BY ts, seq) = 1))
   WHERE rank <= 2"""))
def daily_reminder_cap(spark, d):
    r = reminders(spark, d).withColumn("reminder", K.parse_reminder("reply"))
    return W.daily_reminder_cap(r.filter(F.col("reminder").isNotNull())).withColumn(
        "rank", F.col("rank").cast("bigint"))


# --- aggregations --------------------------------------------------------------

@query("app_event_counts", S.with_views("l0", body="SELECT app_name, count(*) AS n FROM l0 GROUP BY ALL"))
def app_event_counts(spark, d):
    return G.app_event_counts(V.memory(spark, d)).orderBy(F.col("n").desc(), "app_name")


@query("activity_for_days", S.with_views("l0t", "clock", ("recent", """SELECT * FROM l0t  , clock
   WHERE time_start >= date_trunc('day', as_of) - INTERVAL 6 DAY
   AND app_name NOT IN ('clipboard', 'system', 'analyst', 'user', 'dialogue')"""), body="""
   SELECT app_name, n, '- ' || app_name || ' (' || n || ' events)'
     || coalesce(': "' || left(snippet, 80) || '"', '') AS line
   FROM (SELECT app_name, count(*) AS n,
     arg_min(text, (time_start, seq)) FILTER (strlen(text) > 10) AS snippet FROM recent GROUP BY 1)"""))
def activity_for_days(spark, d):
    return G.activity_for_days(V.memory(spark, d, text=True), as_of(spark, d), 7)


@query("activity_hourly", S.with_views("l0", "clock", body="""SELECT h * 3600 AS hour_s,
   (SELECT count(*) FROM l0 WHERE epoch_us(time_start) // 3600000000 = h
      AND time_start >= as_of - INTERVAL 48 HOUR) AS n
   FROM (SELECT as_of, unnest(range(epoch_us(as_of) // 3600000000 - 47, epoch_us(as_of) // 3600000000 + 1)) AS h FROM clock)"""))
def activity_hourly(spark, d):
    return G.activity_hourly(V.memory(spark, d), as_of(spark, d), 48)


@query("rollup_hour_l1", S.with_views("l0t", body="""SELECT epoch_us(time_start) // 3600000000 AS hour,
   min(time_start) AS time_start, max(time_end) AS time_end, count(*) AS count,
   left(coalesce(string_agg(text, chr(10) ORDER BY time_start, seq) FILTER (text <> ''), ''), 2000) AS embed_text
   FROM l0t GROUP BY 1"""))
def rollup_hour_l1(spark, d):
    return G.rollup_hour_l1(V.memory(spark, d, text=True))


@query("rollup_hour_sub_events", S.with_views("l0t", body="""SELECT epoch_us(time_start) // 3600000000 AS hour,
   row_number() OVER (PARTITION BY epoch_us(time_start) // 3600000000 ORDER BY time_start, seq) - 1 AS pos,
   id, epoch_us(time_start) AS t, app_name AS act,
   CASE WHEN app_name = 'clipboard' THEN '' ELSE text END AS ocr_full,
   CASE WHEN app_name = 'clipboard' THEN text ELSE '' END AS clipboard FROM l0t"""))
def rollup_hour_sub_events(spark, d):
    if not V.one_text_each(spark, d):
        return G.rollup_hour_sub_events(V.memory(spark, d, text=True))
    return G.rollup_hour_sub_events(V.memory(spark, d), details=lambda rows: V.with_text(rows, spark, d))


@query("rollup_week_l2", S.with_views("l0t", ("hours", """SELECT epoch_us(time_start) // 3600000000 AS hour,
   min(time_start) AS time_start, max(time_end) AS time_end,
   left(coalesce(string_agg(text, ' ' ORDER BY time_start, seq) FILTER (text <> ''), ''), 200) AS preview
   FROM l0t GROUP BY 1"""), body="""SELECT epoch_us(time_start) // 604800000000 AS week,
   min(time_start) AS time_start, max(time_end) AS time_end, count(*) AS count,
   (epoch_us(max(time_end)) - epoch_us(min(time_start))) // 86400000000 AS span_days,
   left(string_agg(preview, chr(10) ORDER BY time_start, hour), 300) AS summary
   FROM hours GROUP BY 1 HAVING count(*) >= 3 AND (SELECT count(*) FROM hours) >= 5""")
       .replace("SELECT epoch_us(time_start) // 604800000000 AS week,\n   min(time_start) AS time_start",
                "SELECT epoch_us(hours.time_start) // 604800000000 AS week,\n   min(hours.time_start) AS time_start"))
def rollup_week_l2(spark, d):
    return G.rollup_week_l2(G.hour_previews(V.memory(spark, d, text=True)))


@query("event_count", S.with_views("l0", body="SELECT count(*) AS n FROM l0"))
def event_count(spark, d):
    return G.event_count(V.memory(spark, d))


@query("storage_estimate", """SELECT n, avg_chars, avg_chars + 1936 AS record_bytes,
   n * (avg_chars + 1936) AS raw_bytes, 1920::BIGINT AS captures_per_day,
   (avg_chars + 1936) * 1920 AS daily_raw_bytes, (avg_chars + 100) * 1920 AS daily_l1_bytes,
   7 * ((avg_chars + 1936) * 1920 + (avg_chars + 100) * 1920) AS weekly_bytes
   FROM (SELECT count(*) AS n, floor(avg(length(text)))::BIGINT AS avg_chars FROM documents)""")
def storage_estimate(spark, d):
    return G.storage_estimate(V.table(spark, d, "documents"))


LAST100 = ("last100", """SELECT *, row_number() OVER (PARTITION BY scope, metric ORDER BY seq DESC) AS rn
   FROM metrics QUALIFY rn <= 100""")
STATS = ("stats", """SELECT scope, metric, n, s // n AS avg_ms, v[n * 95 // 100 + 1] AS p95_ms,
   v[least(n * 99 // 100, n - 1) + 1] AS p99_ms FROM (SELECT scope, metric, count(*) AS n,
   sum(ms)::BIGINT AS s, list_sort(list(ms)) AS v FROM last100 GROUP BY ALL)""")
HIST = ("hist", """SELECT scope, metric, count(*) FILTER (ms < 50) AS fast,
   count(*) FILTER (ms >= 50 AND ms < 150) AS mid, count(*) FILTER (ms >= 150) AS slow, count(*) AS n
   FROM last100 WHERE rn <= 50 GROUP BY ALL""")
LINKS = ("links", """SELECT scope, count(*) AS total_frames, count(*) FILTER (NOT is_fresh) AS linked,
   round(100 * avg((NOT is_fresh)::INT), 1) AS stability_pct FROM metrics WHERE metric = 'store' GROUP BY ALL""")


@query("latency_stats", S.with_views("metrics", LAST100, STATS, body="SELECT * FROM stats"))
def latency_stats(spark, d):
    return G.latency_stats(V.metrics(spark, d))


@query("latency_histogram", S.with_views("metrics", LAST100, HIST, body="SELECT * FROM hist"))
def latency_histogram(spark, d):
    return G.latency_histogram(V.metrics(spark, d))


@query("perf_report", S.with_views("metrics", LAST100, STATS, HIST, LINKS, body=
       "SELECT l.*, h.fast, h.mid, h.slow, " + ", ".join(
           f"max(CASE WHEN s.metric = '{m}' THEN s.{f} END) AS {m}_{f}" for m in ("ocr", "store", "ttft")
           for f in ("avg_ms", "p95_ms", "p99_ms", "n")) +
       """ FROM stats s JOIN links l USING (scope) JOIN hist h ON h.scope = s.scope AND h.metric = 'ocr'
       GROUP BY ALL"""))
def perf_report(spark, d):
    return G.perf_report(V.metrics(spark, d))


@query("tag_counts", S.with_views("l0t", body="SELECT app_name, tag, count(*) AS n FROM (SELECT app_name, unnest(["
       + ", ".join(S.case([(S.has_any("lower(text)", t) + " OR " + S.has_any("lower(app_name)", a) + " OR "
                            + S.has_any("lower(window_title)", a), S.lit(tag))]) for tag, t, a in rules.TAG_RULES)
       + "]) AS tag FROM l0t) WHERE tag IS NOT NULL GROUP BY GROUPING SETS ((app_name, tag), (tag))"))
def tag_counts(spark, d):
    m = V.memory(spark, d, text=True)
    return G.tag_counts(m.withColumn("tags", K.auto_tag("text", "app_name", "window_title")))
