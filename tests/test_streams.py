"""Streams fed in several batches give the batch result."""
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from recollect.operators import dedup as D
from recollect.operators import joins as X
from recollect.operators import redact as R
from recollect.operators import rollup as G
from recollect.plans.dedup import wordlist
from recollect.sources import views
from recollect.streaming import jobs as Z


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The event table cut into four files by time, read one file per batch."""
    root = tmp_path_factory.mktemp("parts")
    e = views.table(spark, SMALL, "events")
    for i in range(4):
        e.filter(F.col("event_id").between(i * 250, i * 250 + 249)).coalesce(1).write.mode("append").parquet(str(root / "events.parquet"))
    schema = e.schema

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root / "events.parquet"))
    return stream


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_chronos(spark, parts):
    cols = ["stream", "time_start", "seq", "app_name", "window_title", "embedding"]
    s = Z.drain(Z.chronos(views.memory_of(parts(), spark, SMALL, vectors=True).select(*cols)), "t")
    b = D.mark_links(views.memory(spark, SMALL, vectors=True))
    assert rows(s, "seq", "fact", "linked") == rows(b, "seq", "fact", "linked")


def test_frame_gate(spark, parts):
    hashed = lambda m: D.hash_frames(m.withColumn("cells", F.transform("embedding", views.grey)))
    s = Z.drain(Z.frame_gate(hashed(views.memory_of(parts(), spark, SMALL, vectors=True))), "t")
    b = D.frame_gate(hashed(views.memory(spark, SMALL, vectors=True))).filter("accepted")
    assert rows(s, "stream", "seq") == rows(b, "stream", "seq")


def test_clipboard(spark, parts):
    clips = lambda m: m.withColumn("text", F.concat(F.lit("copied text "), (F.col("seq") % 5 > 0).cast("string")))
    s = Z.drain(Z.clipboard(clips(views.memory_of(parts(), spark, SMALL, text=True)), wordlist(spark, SMALL)), "t")
    b = R.clipboard_filter(clips(views.memory(spark, SMALL, text=True)), wordlist(spark, SMALL))
    assert rows(s, "stream", "seq", "text") == rows(b, "stream", "seq", "text")


def test_gate(spark, parts):
    gate, state = views.control_columns()
    merged = parts().select(F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("seq"), gate.alias("gate"),
                            state.alias("state"), (F.col("event_type") == "click").cast("int").alias("kind"))
    s = Z.drain(Z.gate(merged), "t")
    e = views.table(spark, SMALL, "events").filter("event_type = 'click'")
    b = X.capture_gate_asof(e.select(F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("seq")), views.controls(spark, SMALL))
    assert rows(s, "seq", "kept") == rows(b, "seq", "kept")


def test_latency(spark, parts):
    s = Z.drain(Z.latency_window(views.metrics_of(parts())), "t", "update")
    s = s.groupBy("scope", "metric").agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "avg_ms", "p95_ms", "p99_ms")])
    b = G.latency_stats(views.metrics(spark, SMALL))
    cols = ("scope", "metric", "n", "avg_ms", "p95_ms", "p99_ms")
    assert rows(s, *cols) == rows(b, *cols)


def test_hourly_counts(spark, parts):
    s = {r["hour_s"]: r["n"] for r in Z.drain(Z.hourly_counts(views.memory_of(parts(), spark, SMALL)), "t").collect()}
    b = {r["hour_s"]: r["n"] for r in views.memory(spark, SMALL).groupBy(
        (F.unix_timestamp(F.date_trunc("hour", F.col("time_start").cast("timestamp")))).alias("hour_s")).agg(F.count("*").alias("n")).collect()}
    assert s and all(b[h] == n for h, n in s.items()) and len(b) - len(s) <= 2


def fed(spark, tmp_path, batches, schema):
    """A stream of one file per batch, in order."""
    import time
    path = str(tmp_path / "fed")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)  # files are read by their time
    return spark.readStream.schema(spark.createDataFrame(batches[0], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_the_state_of_a_silent_stream_goes(spark, tmp_path):
    from datetime import datetime as D8
    at = lambda h, m=0: D8(2024, 1, 1 + h // 24, h % 24, m)
    row = lambda key, t, seq, text: (key, t, seq, text)
    batches = [[row(1, at(0), 1, "same text here"), row(2, at(0), 2, "same text here")], [row(2, at(9), 3, "other text here")],
               [row(2, at(10), 4, "next text here")], [row(1, at(10, 30), 5, "same text here"), row(2, at(10, 40), 6, "next text here")]]
    schema = "stream long, time_start timestamp_ntz, seq long, text string"
    words = spark.createDataFrame([("zzz",)], "word string")
    kept = lambda ttl, n: {r["seq"] for r in Z.drain(Z.clipboard(fed(spark, tmp_path / str(n), batches, schema), words, ttl), "t").collect()}
    assert kept(Z.TTL, 1) == {1, 2, 3, 4}          # the repeats 5 and 6 are dropped
    assert kept(6 * 3600, 2) == {1, 2, 3, 4, 5}    # stream 1 was silent for longer than its state lives


def test_hour_records_equal_the_batch(spark, parts):
    m = views.memory_of(parts(), spark, SMALL, text=True)
    records = Z.drain(Z.hour_records(m, shares=3), "t")
    got = {r["hour"]: r for r in Z.merge_hours(records).collect()}
    batch = views.memory(spark, SMALL, text=True)
    want = {r["hour"]: r for r in G.rollup_hour_l1(batch).collect()}
    assert got and all(r == want[h] for h, r in got.items()) and len(want) - len(got) <= 2
    members = lambda df: sorted(map(tuple, df.select("hour", "id", "t", "act", "ocr_full", "clipboard").collect()))
    assert members(Z.members_of(records)) == members(G.rollup_hour_sub_events(batch))


def test_hour_records_with_late_texts_equal_the_batch(spark, parts):
    details = lambda rows: views.with_text(rows, spark, SMALL)
    m = views.with_size(views.memory_of(parts(), spark, SMALL), spark, SMALL)
    assert "text" not in m.columns
    records = Z.drain(Z.hour_records(m, shares=3, details=details), "t")
    got = {r["hour"]: r for r in Z.merge_hours(records, details=details).collect()}
    batch = views.memory(spark, SMALL, text=True)
    want = {r["hour"]: r for r in G.rollup_hour_l1(batch).collect()}
    assert got and all(r == want[h] for h, r in got.items()) and len(want) - len(got) <= 2
    members = lambda df: sorted(map(tuple, df.select("hour", "id", "t", "act", "ocr_full", "clipboard").collect()))
    assert members(Z.members_of(records)) == members(G.rollup_hour_sub_events(batch))


def test_sessions_equal_the_batch(spark, parts):
    from recollect.operators import timeline as W
    got = rows(Z.drain(Z.sessions(views.memory_of(parts(), spark, SMALL)), "t"), "stream", "first_ts", "last_ts", "n")
    want = rows(W.sessions(views.memory(spark, SMALL)), "stream", "first_ts", "last_ts", "n")
    assert got and set(got) <= set(want) and len(want) - len(got) < 0.1 * len(want)
