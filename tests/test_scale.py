"""The paths that a hot key, a long list or many queries take give the same
results as the plain ones."""
import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from recollect.functions import times as C
from recollect.operators import dedup as D
from recollect.operators import joins as X
from recollect.operators import redact as R
from recollect.operators import retrieval as V
from recollect.operators import rollup as G
from recollect.operators import timeline as W
from recollect.operators.ordered import Ordered
from recollect.sources import store
from recollect.plans.dedup import wordlist
from recollect.sources import views


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def one_stream(df):
    return df.withColumn("stream", F.lit(1).cast("long"))


def test_ordered_cuts_only_hot_keys(spark):
    m = views.memory(spark, SMALL).withColumn("stream", F.when(F.col("stream") % 2 == 0, 0).otherwise(F.col("stream")))
    plain = Ordered(m, ["stream"], ["time_start", "seq"], C.micros("time_start"))
    cut = Ordered(m, ["stream"], ["time_start", "seq"], C.micros("time_start"), limit=200)
    assert not plain.hot and cut.hot
    assert cut.df.filter("_seg > 0").select("stream").distinct().count() == 1
    for o in (plain, cut):
        o.previous(["seq"], "p")
        o.running_sum(F.lit(1), "n")
        o.last_known([("k", F.when(F.col("app_name") == "Code", F.col("seq")))])
        o.last_known([("b", F.when(F.col("app_name") == "Code", F.col("seq")))], inclusive=False)
    cols = ("stream", "seq", "p", "n", "k", "b")
    assert rows(plain.result(), *cols) == rows(cut.result(), *cols)


def test_links_on_a_hot_stream(spark):
    m = one_stream(views.memory(spark, SMALL, vectors=True))
    m = m.withColumn("window_title", F.lit("w")).withColumn("app_name", F.lit("Code"))
    a, b = (D.mark_links(m, 0.1, limit=n) for n in (10**6, 40))
    assert rows(a, "seq", "fact") == rows(b, "seq", "fact")
    facts = D.chronos_facts(b.withColumn("text", F.lit("")))
    assert facts.agg(F.sum(F.col("deltas") + 1)).first()[0] == 1000   # links partition the rows


def test_frame_gate_on_a_hot_stream(spark):
    f = one_stream(D.hash_frames(views.frames(spark, SMALL)))
    # Repeated frames make the gate depend on its history.
    f = f.withColumns({"phash": F.col("phash").bitwiseAND(F.lit(0x3F3)), "blocks": F.transform("blocks", lambda b: b.bitwiseAND(F.lit(0xFF).cast("long")))})
    a, b = (D.frame_gate(f, limit=n) for n in (10**6, 90))
    assert rows(a, "seq", "accepted") == rows(b, "seq", "accepted")
    assert 0 < a.filter("accepted").count() < 1000


def test_timeline_and_gate_on_hot_keys(spark):
    act = W.with_phrases(W.activity_feed(views.memory(spark, SMALL)))
    a, b = (W.collapse_consecutive(act, (), n) for n in (10**6, 60))
    assert rows(a, "seq") == rows(b, "seq")
    e = views.table(spark, SMALL, "events").filter("event_type = 'click'")
    e = one_stream(e.select("ts", F.col("event_id").alias("seq"), F.lit(0).alias("stream"))).select("stream", "ts", "seq")
    c = one_stream(views.controls(spark, SMALL))
    a, b = (X.capture_gate_asof(e, c, limit=n) for n in (10**6, 70))
    assert rows(a, "seq", "kept") == rows(b, "seq", "kept")


def test_clipboard_and_notes_on_hot_keys(spark):
    m = one_stream(views.memory(spark, SMALL, text=True)).withColumn(
        "text", F.when(F.col("seq") % 3 == 0, F.lit("same text again")).otherwise(F.substring("text", 1, 30)))
    a, b = (R.clipboard_filter(m, wordlist(spark, SMALL), limit=n) for n in (10**6, 60))
    assert rows(a, "seq") == rows(b, "seq")
    a, b = (G.rollup_hour_sub_events(m, limit=n) for n in (10**6, 1))
    assert rows(a, "hour", "pos", "id") == rows(b, "hour", "pos", "id")


def test_entities_in_a_hot_conversation(spark):
    asks = views.asks(spark, SMALL).withColumn("turn", F.col("conv_id") * 100 + F.col("turn")).withColumn("conv_id", F.lit(1))
    a, b = (W.entity_tracking(asks, limit=n) for n in (10**6, 6))
    cols = ("episode", "name", "facts", "search_term")
    assert rows(a, *cols) == rows(b, *cols)
    a, b = (W.backreference_resolve(asks, limit=n) for n in (10**6, 6))
    assert rows(a, "turn", "resolved") == rows(b, "turn", "resolved")


def test_knn_is_exact_on_both_paths(spark):
    m = views.memory(spark, SMALL, vectors=True)
    q = views.questions(spark, SMALL)
    pdf, qdf = m.select("seq", "embedding").toPandas(), q.select("query_id", "embedding").toPandas()
    mat, seqs = np.array(pdf["embedding"].tolist(), dtype=float), pdf["seq"].to_numpy()
    want = set()
    for qid, v in zip(qdf["query_id"], qdf["embedding"]):
        d = ((mat - np.array(v, dtype=float)) ** 2).sum(axis=1)
        for rank, i in enumerate(np.lexsort((seqs, d))[:7]):
            want.add((qid, seqs[i], rank + 1))
    for shared in (V.MAX_SHARED_QUERIES, 5):
        got = V.knn(m, q, 7, max_shared=shared)
        assert set(map(tuple, got.select("query_id", "seq", "rank").collect())) == want


def test_knn_blocks_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_QUERIES", 10)
    monkeypatch.setattr(V, "BLOCK_VECTORS", 200)
    m, q = views.memory(spark, SMALL, vectors=True), views.questions(spark, SMALL)
    a = V.knn(m, q, 7, max_shared=10**6)
    b = V.knn(m, q, 7, max_shared=10)
    assert rows(a, "query_id", "seq", "rank") == rows(b, "query_id", "seq", "rank")


def test_knn_by_cosine(spark):
    m, q = views.memory(spark, SMALL, vectors=True), views.questions(spark, SMALL)
    # Unit vectors: both metrics give the same order.
    a, b = (V.knn(m, q, 3, metric) for metric in ("l2", "cosine"))
    assert rows(a, "query_id", "seq") == rows(b, "query_id", "seq")


def test_embed_once_salts_copies(spark):
    m = views.memory(spark, SMALL).withColumn("text", F.when(F.col("seq") % 3 == 0, F.lit("copy")).otherwise(F.col("id")))
    embed = lambda t: V.embed_text(t, "text", 16)
    a, b = (D.embed_once(m.select("seq", "text"), "text", embed, limit=n) for n in (10**6, 20))
    assert rows(a, "seq", "embedding") == rows(b, "seq", "embedding")
    assert b.filter(F.size("embedding") == 16).count() == 1000


def test_rollup_conserves_rows(spark):
    m = views.memory(spark, SMALL, text=True)
    assert G.rollup_hour_l1(m).agg(F.sum("count")).first()[0] == 1000
    parts = G.hour_record_parts(G.rollup_hour_sub_events(m), chunk=1)
    assert parts.count() == 1000


def test_long_token_stream(spark):
    lines = spark.range(500).select(F.lit(1).alias("stream_id"), F.col("id").alias("seq"), F.concat(
        F.lit('data: {"content":"'), F.col("id").cast("string"), F.lit(' ","stop":'), (F.col("id") == 400).cast("string"), F.lit("}")).alias("line"))
    want = "".join(f"{i} " for i in range(401))
    for n in (10**6, 30):
        assert store.token_stream_decode(lines, chunk=20, limit=n).first()["text"] == want


def test_hour_members_are_ordered_without_texts(spark):
    """Texts that join after the positions are not shuffled by hour, and the members are the same."""
    from recollect.plans import all_queries
    from recollect.sources import views as V
    late = all_queries()["rollup_hour_sub_events"](spark, SMALL)
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[plan.index("Join"):]
    early = G.rollup_hour_sub_events(V.memory(spark, SMALL, text=True))
    assert V.one_text_each(spark, SMALL) and sorted(map(str, late.collect())) == sorted(map(str, early.collect()))


def test_hour_records_shuffle_texts_once_and_sort_none(spark):
    m = views.memory(spark, SMALL, text=True)
    for chunk in (10_000, 1, 2, 3):
        a = G.hour_records(m, chunk, limit=5)
        b = G.hour_record_parts(G.rollup_hour_sub_events(m), chunk)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    plan = G.hour_records(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and not any(
        "text" in line for line in plan.splitlines() if "Window" in line or "Sort" in line)
