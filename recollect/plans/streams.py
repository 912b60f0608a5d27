"""Queries: streaming jobs, run over the whole tables until nothing is left."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import payload as J
from recollect.operators import dedup as D
from recollect.plans import sql as S
from recollect.plans.dedup import (ISLANDS, MARKED, SEED_CLEAN, TOKS, WORDS, lagged, scrub_cards_sql,
                                   scrub_tokens_sql, wordlist)
from recollect.plans.registry import ORACLES, query
from recollect.plans.timeline import REMIND, as_of
from recollect.session import scratch_path
from recollect.sources import store
from recollect.sources import views as V
from recollect.streaming import jobs as Z

L = F.lit


def memory_stream(spark, d, text=False, vectors=False):
    """The memory view over the streamed event table (texts and vectors are
    static tables joined to the stream)."""
    events = Z.read_table(spark, d, "events")
    if text or vectors:
        # A batch of few files would keep the text work on few cores; the events
        # are narrow here, before texts join.
        events = events.repartition(spark.sparkContext.defaultParallelism, "event_id")
    return V.memory_of(events, spark, d, text, vectors)


TAGS = "len(list_filter([" + ", ".join(S.case([(S.has_any("lower(text)", t) + " OR " + S.has_any("lower(app_name)", a) + " OR "
        + S.has_any("lower(window_title)", a), S.lit(tag))]) for tag, t, a in rules.TAG_RULES) + "], lambda x: x IS NOT NULL))"
DROPPED = ("(" + S.has_any("lower(window_title)", rules.PRIVATE_WINDOW_MARKERS) + " OR " + S.has_any("lower(app_name)", rules.PRIVATE_WINDOW_MARKERS)
           + " OR " + S.has_any("lower(window_title)", rules.TITLE_BLACKLIST) + " OR " + S.has_any("lower(app_name)", rules.MESSENGER_APPS) + ")")


@query("stream_ingest", S.with_views(("sdocs", "SELECT doc_id, source, lang, text FROM documents"), WORDS, TOKS, ISLANDS, SEED_CLEAN,
    ("l0s", S.VIEWS["l0t"].replace("documents d", "seedclean d")), ("k", f"SELECT * FROM l0s WHERE NOT {DROPPED}"), ("a", f"SELECT * REPLACE ({scrub_tokens_sql('text')} AS text) FROM k"),
    ("b", f"SELECT * REPLACE ({scrub_cards_sql('text')} AS text) FROM a"), body=f"SELECT id, md5(text) AS text, {TAGS} AS tags FROM b"))
def stream_ingest(spark, d):
    out = Z.ingest(memory_stream(spark, d, text=True), wordlist(spark, d)).select(
        "id", F.md5("text").alias("text"), F.size("tags").cast("bigint").alias("tags"))
    return Z.drain(out, "ingest")


@query("stream_chronos", S.with_views("l0v", lagged("l0v"), MARKED, body="SELECT stream, seq, fact, linked FROM marked"))
def stream_chronos(spark, d):
    m = memory_stream(spark, d, vectors=True).select("stream", "time_start", "seq", "app_name", "window_title", "embedding")
    return Z.drain(Z.chronos(m), "chronos").select("stream", "seq", "fact", "linked")


CLOSED = "(epoch_us(time_start) // 3600000000 + 1) * 3600000000 <= (SELECT epoch_us(as_of) FROM clock) - 600000000"


@query("stream_hourly_counts", S.with_views("l0", "clock", body=f"""SELECT epoch_us(time_start) // 3600000000 * 3600 AS hour_s, count(*) AS n
   FROM l0 WHERE {CLOSED} GROUP BY 1"""))
def stream_hourly_counts(spark, d):
    return Z.drain(Z.hourly_counts(memory_stream(spark, d)), "hourly")


@query("stream_rollup_hour", S.with_views("l0", "clock", body=f"""SELECT epoch_us(l0.time_start) // 3600000000 AS hour, min(l0.time_start) AS time_start,
   max(time_end) AS time_end, count(*) AS count FROM l0 WHERE {CLOSED.replace('time_start', 'l0.time_start')} GROUP BY 1"""))
def stream_rollup_hour(spark, d):
    return Z.drain(Z.rollup_hours(memory_stream(spark, d)), "rollup")


@query("stream_hour_records", S.with_views("l0t", "clock", body=f"""SELECT epoch_us(l0t.time_start) // 3600000000 AS hour,
   min(l0t.time_start) AS time_start, max(time_end) AS time_end, count(*) AS count,
   md5(left(coalesce(string_agg(text, chr(10) ORDER BY l0t.time_start, seq) FILTER (text <> ''), ''), 2000)) AS embed_text,
   bit_xor(('0x' || left(md5(id || ' ' || app_name || ' ' || text), 15))::BIGINT) AS members
   FROM l0t WHERE {CLOSED.replace('time_start', 'l0t.time_start')} GROUP BY 1"""))
def stream_hour_records(spark, d):
    """Records of closed hours and a digest of their members, from one stream."""
    details = None  # texts meet their rows behind the state where a row has one text at most
    if V.one_text_each(spark, d):
        details = lambda rows: V.with_text(rows, spark, d)
        m = V.with_size(memory_stream(spark, d), spark, d)
    else:
        m = memory_stream(spark, d, text=True)
    records = Z.drain(Z.hour_records(m, details=details), "hour-records")
    text = F.concat_ws(" ", "id", "act", F.concat("ocr_full", "clipboard"))
    members = Z.members_of(records).groupBy("hour").agg(
        F.bit_xor(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")).alias("members"))
    heads = Z.merge_hours(records, details=details).withColumn("embed_text", F.md5("embed_text"))
    return heads.join(members, "hour")


@query("stream_sessions", ORACLES["sessions"].replace("GROUP BY stream, session",
    "GROUP BY stream, session HAVING max(time_start) + INTERVAL 40 MINUTE <= (SELECT max(time_start) FROM l0)"))
def stream_sessions(spark, d):
    """Sessions that the watermark has closed."""
    return Z.drain(Z.sessions(memory_stream(spark, d)), "sessions")


@query("stream_clipboard_dedup", ORACLES["clipboard_filter"].replace("SELECT stream, id, md5(text)", "SELECT stream, seq, md5(text)"))
def stream_clipboard_dedup(spark, d):
    m = memory_stream(spark, d, text=True).filter(F.col("app_name") == "clipboard")
    clips = m.withColumn("text", F.when(F.col("seq") % 2 == 0, F.concat(
        L("  copied "), F.col("stream").cast("string"), L(" \n"))).otherwise(F.col("text")))
    return Z.drain(Z.clipboard(clips, wordlist(spark, d)), "clipboard").select("stream", "seq", F.md5("text").alias("text"))


@query("stream_frame_gate", ORACLES["frame_gate"])
def stream_frame_gate(spark, d):
    m = memory_stream(spark, d, vectors=True).withColumn("cells", F.transform("embedding", V.grey))
    return Z.drain(Z.frame_gate(D.hash_frames(m)), "frames").select("stream", "seq")


@query("stream_reminder_cap", S.with_views("l0", REMIND, body="""SELECT day, reminder, ts, rank::INT AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, seq) AS rank FROM (
     SELECT * FROM reminders QUALIFY row_number() OVER (PARTITION BY day, reminder ORDER BY ts, seq) = 1)) WHERE rank <= 2"""))
def stream_reminder_cap(spark, d):
    m = memory_stream(spark, d)
    reply = F.when(F.col("seq") % 5 == 0, L("IDLE")).otherwise(F.concat(
        L('ok [ACTION: REMIND(" call '), "app_name", L(' ")] end')))
    r = m.select(F.date_format("time_start", "yyyy-MM-dd").alias("day"), F.col("time_start").alias("ts"), "seq",
                 K.parse_reminder(reply).alias("reminder")).filter(F.col("reminder").isNotNull())
    return Z.drain(Z.reminder_cap(r), "reminders")


@query("stream_gate", ORACLES["capture_gate_asof"])
def stream_gate(spark, d):
    gate, state = V.control_columns()
    merged = Z.read_table(spark, d, "events").select(
        F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("seq"), gate.alias("gate"),
        state.alias("state"), (F.col("event_type") == "click").cast("int").alias("kind"))
    return Z.drain(Z.gate(merged), "gate")


@query("stream_latency_window", ORACLES["latency_stats"])
def stream_latency_window(spark, d):
    rows = Z.drain(Z.latency_window(V.metrics_of(Z.read_table(spark, d, "events"))), "latency", "update")
    return rows.groupBy("scope", "metric").agg(*[
        F.max_by(c, "batch").alias(c) for c in ("n", "avg_ms", "p95_ms", "p99_ms")])


@query("stream_answer_cache", ORACLES["jaccard_cache_join"].replace("SELECT query_id, hit_id, round(s, 6) AS similarity FROM walk", "SELECT query_id, hit_id FROM walk"))
def stream_answer_cache(spark, d):
    asks = V.asks_of(Z.read_table(spark, d, "conversations"))
    return Z.drain(Z.answer_cache(asks.withColumn("query_id", F.col("conv_id") * 1_000_000_000 + F.col("turn"))), "cache")


def into_table(spark, memory, run):
    """A stream of memory rows written into a fresh table, each batch once."""
    path, state = scratch_path(spark, "sink"), scratch_path(spark, "sink-checkpoint")
    q = (store.stored(memory).writeStream.option("checkpointLocation", state).trigger(availableNow=True)
         .foreachBatch(store.sink(path, run)).start())
    q.awaitTermination()
    return path


@query("stream_forget", S.with_views("l0", "clock", body="""SELECT strftime(time_start, '%Y-%m-%d') AS date, count(*) AS n
   FROM l0, clock WHERE time_start < as_of - INTERVAL 3000 MINUTE GROUP BY ALL"""))
def stream_forget(spark, d):
    """Rows streamed into the table, then the newest ones forgotten there."""
    path = into_table(spark, memory_stream(spark, d, text=True), "forget")
    store.forget_recent(spark, path, as_of(spark, d), 3000)
    return store.read_memory(spark, path).groupBy(F.col("date").cast("string").alias("date")).agg(F.count(L(1)).alias("n"))


@query("ingest_stream", S.with_views("l0t", body="""SELECT CASE WHEN app_name = 'clipboard' THEN 'Clipboard' ELSE window_title END AS window_title, app_name,
   count(*) AS n, sum(length(text))::BIGINT AS chars, bit_xor(('0x' || left(md5(id || text), 15))::BIGINT) AS texts FROM l0t GROUP BY ALL"""))
def ingest_stream(spark, d):
    """Screen and clipboard events, with their texts, into the memory table."""
    m = memory_stream(spark, d, text=True)
    title = F.when(F.col("app_name") == "clipboard", L("Clipboard")).otherwise(F.col("window_title"))
    path = into_table(spark, m.withColumn("window_title", title), "events")
    v = J.parsed("data_json")
    rows = store.read_memory(spark, path).select("id", *[J.string_field(v, c).alias(c) for c in ("window_title", "app_name", "text")])
    return rows.groupBy("window_title", "app_name").agg(
        F.count(L(1)).alias("n"), F.sum(F.length("text")).alias("chars"),
        F.bit_xor(F.conv(F.substring(F.md5(F.concat("id", "text")), 1, 15), 16, 10).cast("bigint")).alias("texts"))
