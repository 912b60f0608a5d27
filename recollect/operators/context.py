"""Context and prompt assembly, answer post-processing, generated documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import numbers as N
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators import joins as X
from recollect.operators import redact
from recollect.operators import rollup as G

PROMPT_CHARS = 2500


def clean_memory(c):
    """Noise and inner labels out; '' for an empty context."""
    c = T.col(c)
    empty = (c == "") | c.contains(rules.NOTHING_FOUND)
    return F.when(empty, F.lit("")).otherwise(T.strip_markers(T.clean_noise_chars(c)))


def hybrid_context(questions, memory, web):
    """V9: memory and web text per question; the web is left out when offline or
    when the question is about one's own past."""
    offline = F.col("offline") & ~T.contains_any(F.lower("text"), rules.FORCE_ONLINE)
    wanted = ~offline & ~K.is_activity_recall("text") & (
        K.needs_web("text") | K.entity_in_question("text").isNotNull())
    return (questions.join(memory, "query_id", "left").join(web, "query_id", "left")
            .withColumn("memory", F.coalesce("memory", F.lit("")))
            .withColumn("web", F.when(wanted, F.coalesce("web", F.lit(""))).otherwise("")))


def context_bundle(rows, as_of, wordlist, zone="UTC"):
    """Clock line, cleaned and scrubbed memory, web and conflicts, as one text
    per query."""
    clean = redact.scrub_with(rows.withColumn("memory", clean_memory("memory")), wordlist, "query_id", "memory")
    clean = clean.withColumn("_conflicts", X.row_conflicts("memory", "web"))
    clock = F.concat(F.lit("Local time: "), F.date_format(C.to_local(as_of, zone), "dd.MM.yyyy HH:mm"),
                     F.lit(" (by the clock; says nothing about when the model was made)."))

    def part(label, c):
        return F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))

    return clean.withColumn("bundle", F.concat_ws(
        "\n\n", clock, part("From the screen:\n", "memory"), part("From the web:\n", "web"),
        X.notice_of(F.col("_conflicts")))).drop("_conflicts")


def prompt_table(rows, system, profile=""):
    """The chat prompt around a bundle."""
    ctx = F.substring("bundle", 1, PROMPT_CHARS)
    prefix = f"{profile}\n\n" if profile else ""
    has = (T.trim_ws(ctx) != "") & ~ctx.contains(rules.NOTHING_FOUND)
    user = F.when(has, F.concat(F.lit(f"<context>\n{prefix}"), ctx, F.lit("\n</context>\n\n"), "text")) \
        .otherwise(F.concat(F.lit(prefix), "text"))
    return rows.withColumn("prompt", F.concat(
        F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), user,
        F.lit("<|im_end|>\n<|im_start|>assistant\n")))


def answer_postprocess(rows, lang=None):
    """The reply, foreign script removed, checked against the web text; a
    reply with unbacked figures gives way to the raw lines, one about an unknown
    name gets a caveat."""
    rows = rows.withColumn("_a", T.strip_cjk(T.extract_answer("raw"), lang))
    bad = (T.trim_ws("web") != "") & (F.col("_a") != "") & ~N.is_grounded("_a", "web")
    rows = rows.withColumn("_b", F.when(bad, T.dedup_lines_topn(
        "memory", "web", rules.NOTICE_UNVERIFIED)).otherwise(F.col("_a")))
    named = K.named_entity("text")
    rows = rows.withColumn("_n", named)
    unknown = F.col("_n").isNotNull() & ~K.entity_grounded(
        "_n", F.concat("memory", F.lit(" "), "web"))
    return rows.withColumn("answer", F.when(unknown & (F.col("_b") != ""), F.concat(
        "_b", F.lit("\n\n" + rules.CAVEAT))).otherwise(F.col("_b"))).drop("_a", "_b", "_n")


def dialogue_persist(rows):
    """question/answer pairs worth storing, as memory events."""
    keep = (F.octet_length("answer") >= rules.MIN_ANSWER_BYTES) & ~F.col("answer").startswith(
        rules.SKIP_ANSWER_START)
    return rows.filter(keep).select("ts", F.concat(
        F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("text"),
        F.lit("dialogue").alias("app_name"), F.lit("qa").alias("window_title"))


def activity_text(memory, as_of, days, zone="UTC"):
    """The lines of G2 as one text: one line per app, so few and short."""
    lines = G.activity_for_days(memory, as_of, days, zone)
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct((-F.col("n")).alias("_n"), "app_name", "line"))), lambda r: r["line"]), "\n")
        .alias("activity"))


def report_document(memory, as_of, days, text=None):
    """P5: a report with the recorded facts attached.  Without a generated text
    the body is the plain activity list."""
    period = {1: "today"}.get(days, f"the last {days} days")
    fallback = f"Activity report {period}"
    facts = activity_text(memory, as_of, days)
    body = F.lit(text) if text is not None else F.concat(
        F.lit(f"Activity report — {period}\n\n"), "activity")
    split = facts.withColumn("_p", T.split_title_body(body, F.lit(fallback)))
    return split.filter(T.trim_ws("activity") != "").select(
        T.report_title("_p.title", F.lit(fallback)).alias("title"),
        F.concat("_p.body", F.lit("\n\n---\n\n## Source — what was actually recorded\n\n"), "activity")
        .alias("document"))


def daily_summary_record(memory, summaries=None):
    """One summary record per day from at most 1500 characters of activity.

    `summaries` (day, summary) holds generated texts; days without one use the
    activity itself."""
    rows = memory.filter(~F.col("app_name").isin(rules.SUMMARY_SKIP_APPS)).withColumn(
        "day", F.date_format("time_start", "yyyy-MM-dd"))
    ok = F.octet_length("text") > 10
    per_app = rows.groupBy("day", "app_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.when(ok, F.substring("text", 1, 80)), F.when(ok, F.struct("time_start", "seq"))).alias("snippet"))
    line = F.concat(F.lit("- "), "app_name", F.lit(" ("), F.col("n").cast("string"), F.lit(" events)"),
                    F.coalesce(F.concat(F.lit(': "'), "snippet", F.lit('"')), F.lit("")))
    # A line has 14 characters or more, so 107 lines fill 1500; the rank prunes.
    busiest = Window.partitionBy("day").orderBy(F.col("n").desc(), "app_name")
    per_app = per_app.withColumn("_rn", F.row_number().over(busiest)).filter(F.col("_rn") <= 107)
    per_day = per_app.groupBy("day").agg(F.substring(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("_n"), "app_name", line.alias("line")))),
        lambda r: r["line"]), "\n"), 1, 1500).alias("activity"))
    if summaries is not None:
        per_day = per_day.join(summaries, "day", "left")
        text = F.coalesce("summary", "activity")
    else:
        text = F.col("activity")
    return per_day.select("day", F.concat(F.lit("[DAILY SUMMARY — "), "day", F.lit("]\n"), text).alias("record"))
