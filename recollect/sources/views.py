"""Activity-memory views over the supplied tables.

The tables carry no window titles, questions or control signals, so these views
derive them from every row of the tables, by rules the oracle SQL repeats.
Each join is optional: a caller that needs no text or vector reads neither.
"""

from pyspark.sql import functions as F

from recollect.functions.times import from_micros, micros
from recollect.session import use_utc

APP_BY_TYPE = {"click": "firefox", "view": "Code", "purchase": "spotify",
               "signup": "dialogue", "error": "clipboard"}
TYPE_INDEX = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}
QA_EPOCH = "2024-01-01 00:00:00"
QUESTION_EPOCH = "2024-01-15 00:00:00"

# Question shapes set around every sentence of a turn, so that each rule meets some rows.
ASK_SHAPES = [
    "who is {}?", "tell me about {}", "what did i do with {} today", "open video about him",
    "he is a {} player, find him", "what is {} about?", "write a report of my week on {}",
    "what is my name", "who are you", "do you have my {} password", "latest {} news",
    "how do i write {}", "no his nickname is {}", "play her", "hey, who was {}?",
    "i mean the {} one and", "what video am i watching {}", "where is it",
    "describe {} Theory now", "search his {} channel",
]


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def pages(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"), "page_id")


def table(spark, sf_dir, name):
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df, *key):
    """Give a scan at least one partition per core.

    A large table has more splits than cores and is left alone; one small file
    would otherwise keep all text work on a single core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


def lookup(c, mapping):
    out = F.lit(None)
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def row_total(df):
    """The row count, one number that Parquet footers hold."""
    return F.lit(df.count())


def memory(spark, sf_dir, text=False, vectors=False):
    """Level-0 memory rows from `events`; text from `documents`, vectors from
    `embeddings`, both spread over all of those tables' rows."""
    e = table(spark, sf_dir, "events")
    if text or vectors:
        e = spread(e, "event_id")
    return memory_of(e, spark, sf_dir, text, vectors)


def memory_of(e, spark, sf_dir, text=False, vectors=False):
    """The memory view over a given (batch or streaming) frame of events."""
    u = F.col("user_id")
    kind = u % 4
    title = (F.when(kind == 0, F.format_string("(3) Clip %d - YouTube — Mozilla Firefox", u))
             .when(kind == 1, F.format_string("main_%d.py - Visual Studio Code", u))
             .when(kind == 2, F.format_string("Song %d | Spotify", u))
             .otherwise(F.lit("")))
    out = e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("seq"),
        u.alias("stream"), F.col("ts").alias("time_start"), F.col("ts").alias("time_end"),
        F.lit(0).alias("level"), F.lit(False).alias("archived"),
        lookup(F.col("event_type"), APP_BY_TYPE).alias("app_name"),
        title.alias("window_title"),
        lookup(F.col("event_type"), TYPE_INDEX).alias("_type"))
    if text:
        out = with_text(out, spark, sf_dir)
    if vectors:
        vecs = table(spark, sf_dir, "embeddings")
        out = (out.withColumn("_vec", (F.col("stream") * 10 + F.col("_type") * 2
                                       + F.col("seq") % 2) % row_total(vecs))
               .join(vecs.select(F.col("vec_id").alias("_vec"), "embedding"), "_vec", "left")
               .drop("_vec"))
    return out.drop("_type")


def with_text(rows, spark, sf_dir):
    """Memory rows with their texts; few rows bring few texts."""
    docs = table(spark, sf_dir, "documents")
    return (rows.withColumn("_doc", F.col("seq") % row_total(docs))
            .join(docs.select(F.col("doc_id").alias("_doc"), "text"), "_doc", "left")
            .withColumn("text", F.coalesce("text", F.lit(""))).drop("_doc"))


def with_size(rows, spark, sf_dir):
    """Memory rows with the length of the text that `with_text` gives them."""
    docs = table(spark, sf_dir, "documents")
    return (rows.withColumn("_doc", F.col("seq") % row_total(docs))
            .join(docs.select(F.col("doc_id").alias("_doc"), F.length("text").alias("size")), "_doc", "left")
            .withColumn("size", F.coalesce("size", F.lit(0))).drop("_doc"))


def one_text_each(spark, sf_dir):
    """Whether a memory row meets one text at most, so that texts may join at any step."""
    ids = table(spark, sf_dir, "documents").filter(F.col("doc_id").isNotNull())
    return ids.groupBy("doc_id").count().filter("count > 1").isEmpty()


def payloads(spark, sf_dir):
    """Memory rows as stored: one JSON text per row.  Some rows are of the odd
    kinds a store meets: numbers for text, broken JSON, no app at all."""
    m = memory(spark, sf_dir, text=True)
    body = F.to_json(F.struct(
        "app_name", "window_title", "text", F.array().cast("array<string>").alias("tags"),
        F.array().cast("array<struct<t:bigint,text:string>>").alias("deltas"),
        (F.col("seq") % 10 == 0).alias("is_stress")))
    odd = F.col("seq") % 97
    return m.select("id", "seq", "stream", "time_start", "time_end", "level", F.when(
        odd == 1, F.lit('{"app_name":5,"window_title":true,"text":12}')).when(
        odd == 2, F.concat(F.lit('{"app_name":"x","text":'), "id")).when(
        odd == 3, F.to_json(F.struct(F.col("text").alias("summary")))).otherwise(body)
        .alias("data_json"))


def qa_pairs(spark, sf_dir):
    """Each user turn with the assistant turn that follows it."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter(F.col("role") == "user")
    replied = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(replied, ["conv_id", "turn"]).select(
        turn_time().alias("ts"), "conv_id", "turn", F.col("text").alias("question"), "answer")


def turn_time():
    us = (F.col("conv_id") * 3600 + F.col("turn") * 60) * 1_000_000
    return from_micros(micros(F.lit(QA_EPOCH).cast("timestamp_ntz")) + us)


def asks(spark, sf_dir):
    """What is said and asked: every turn as it is, and each of its sentences in a question shape."""
    return asks_of(spread(table(spark, sf_dir, "conversations"), "conv_id", "turn"))


PARTS = 100_000  # more than a turn has sentences


def asks_of(c):
    """`turn` numbers the rows of a conversation; `of_turn` is the turn they come from."""
    subjects = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^.\n]+"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")

    def shaped(subject, i):
        shape = (F.col("conv_id") * 3 + F.col("turn") * 5 + i + 1) % len(ASK_SHAPES)
        text = F.lit("")
        for n, s in enumerate(ASK_SHAPES):
            head, _, tail = s.partition("{}")
            filled = F.concat(F.lit(head), subject, F.lit(tail)) if "{}" in s else F.lit(s)
            text = F.when(shape == n, filled).otherwise(text)
        return F.struct((i + 1).alias("part"), text.alias("text"))

    rows = F.concat(F.array(F.struct(F.lit(0).alias("part"), "text")), F.transform(subjects, shaped))
    out = c.select("conv_id", F.col("turn").alias("of_turn"), turn_time().alias("at"), F.explode(rows).alias("said"))
    return out.select("conv_id", (F.col("of_turn") * PARTS + F.col("said.part")).alias("turn"), "of_turn",
                      from_micros(micros("at") + F.col("said.part") * 1000).alias("ts"), F.col("said.text").alias("text"))


def questions(spark, sf_dir):
    """The benchmark items as timed questions with a vector each."""
    b = table(spark, sf_dir, "benchmark")
    vecs = table(spark, sf_dir, "embeddings")
    at = from_micros(micros(F.lit(QUESTION_EPOCH).cast("timestamp_ntz"))
                     + F.col("item_id") * 60_000_000)
    return (b.select(F.col("item_id").alias("query_id"), at.alias("ts"), "text",
                     (F.col("item_id") % row_total(vecs)).alias("vec_id"))
            .join(vecs.select("vec_id", "embedding"), "vec_id"))


def metrics(spark, sf_dir):
    """Latency samples: one per event."""
    return metrics_of(table(spark, sf_dir, "events"))


def metrics_of(e):
    name = F.when(F.col("user_id") % 3 == 0, "ocr").when(F.col("user_id") % 3 == 1, "store") \
        .otherwise("ttft")
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "realtime").otherwise("stress").alias("scope"),
        name.alias("metric"), F.col("event_id").alias("seq"),
        F.floor(F.col("value") * 10).cast("long").alias("ms"),
        (F.col("event_id") % 3 == 0).alias("is_fresh"))


def control_columns():
    """Gate and state that an event signals; NULL for events that are no signal."""
    kind = F.col("event_type")
    gate = lookup(kind, {"signup": "consent", "error": "incognito", "purchase": "cpu", "view": "game"})
    state = (F.when(kind == "click", F.lit(None).cast("double")).when(kind == "signup", F.lit(1.0))
             .when(kind == "purchase", F.col("value"))
             .when(F.col("value") > 50, F.lit(1.0)).otherwise(F.lit(0.0)))
    return gate, state


def controls(spark, sf_dir):
    """Control signals from the signup, error, purchase and view events."""
    gate, state = control_columns()
    return table(spark, sf_dir, "events").filter(F.col("event_type") != "click").select(
        F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("seq"),
        gate.alias("gate"), state.alias("state"))


def frames(spark, sf_dir):
    """Screen frames: the vector of each memory row read as an 8 x 8 grey image."""
    m = memory(spark, sf_dir, vectors=True)
    return m.select("stream", "time_start", "seq", "app_name", F.transform(
        "embedding", lambda x: grey(x)).alias("cells"))


def grey(x):
    """A vector component as an integer grey value."""
    return F.floor((x.cast("double") + 1.0) * 1000).cast("int")


def blocks(spark, sf_dir):
    """Long table of pixels: vectors as blocks, four blocks to a frame."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.expr("vec_id div 4").alias("frame"), (F.col("vec_id") % 4).alias("block"),
                    F.posexplode(F.transform("embedding", grey)).alias("pos", "value"))
