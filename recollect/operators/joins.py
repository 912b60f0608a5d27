"""Joins: conflicting values, set-based grounding, as-of gates, lookups, spines."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import numbers as N
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators.ordered import HOT_ROWS, Ordered


def key_facts(cases, key, text):
    """X1 helper: per case, the first value that follows each word of 4 bytes or
    more, where the value holds a digit."""
    pairs = cases.select(key, F.posexplode(T.let(T.words(text), lambda ws: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ws) - 2, F.lit(0))),
        lambda i: F.struct(T.trim_alnum(F.lower(F.get(ws, i))).alias("word"),
                           F.get(ws, i + 1).alias("value"))))).alias("pos", "p"))
    hits = pairs.filter(F.col("p.value").rlike("[0-9]") & (F.octet_length("p.word") >= 4))
    return hits.groupBy(key, F.col("p.word").alias("word")).agg(
        F.min_by("p.value", "pos").alias("value"))


def detect_conflicts(cases, key, memory, web, cap=5):
    """Words whose first value differs between the two texts of a case.

    The report shows five per case, by word; the ranking prunes before it shuffles."""
    a = key_facts(cases, key, memory).withColumnRenamed("value", "local")
    b = key_facts(cases, key, web).withColumnRenamed("value", "web")
    differ = a.join(b, [key, "word"]).filter(F.col("local") != F.col("web"))
    w = Window.partitionBy(key).orderBy("word")
    return (differ.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= cap))


def first_facts(text):
    """X1 in a row: word -> the first value with a digit that follows it."""
    pairs = T.let(T.words(text), lambda ws: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(ws) - 2, F.lit(0))),
        lambda i: F.struct(T.trim_alnum(F.lower(F.get(ws, i))).alias("word"), i.alias("pos"), F.get(ws, i + 1).alias("value"))))
    hits = F.filter(pairs, lambda p: p["value"].rlike("[0-9]") & (F.octet_length(p["word"]) >= 4))
    once = T.let(F.array_sort(hits), lambda s: F.filter(
        s, lambda p, i: (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["word"] != p["word"])))
    return F.map_from_entries(F.transform(once, lambda p: F.struct(p["word"], p["value"])))


def row_conflicts(memory, web, cap=5):
    """X1 as a column of a row that holds both texts: at most `cap` conflicts, by word."""
    both = F.map_zip_with(first_facts(memory), first_facts(web), lambda k, a, b: F.when(
        a != b, F.struct(a.alias("local"), b.alias("web"))))
    found = F.array_sort(F.filter(F.map_entries(both), lambda e: e["value"].isNotNull()))
    return F.slice(F.transform(found, lambda e: F.struct(
        e["key"].alias("word"), e["value"]["local"].alias("local"), e["value"]["web"].alias("web"))), 1, cap)


def notice_of(conflicts):
    """The sentence for an array of conflicts; null where there are none."""
    items = F.transform(conflicts, lambda c: F.concat(
        F.lit("«"), c["word"], F.lit("»: local="), c["local"], F.lit(", web="), c["web"]))
    return F.when(F.size(conflicts) > 0, F.concat(
        F.lit("Screen and web disagree: "), F.array_join(items, "; "), F.lit(". Name both values.")))


def conflict_notice(conflicts, key):
    """The conflicts of a case (five at most) as one sentence."""
    item = F.concat(F.lit("«"), "word", F.lit("»: local="), "local", F.lit(", web="), "web")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))),
                         lambda r: r["item"])
    return conflicts.groupBy(key).agg(F.concat(
        F.lit("Screen and web disagree: "), F.array_join(listed, "; "),
        F.lit(". Name both values.")).alias("notice"))


def grounding_antijoin(cases, key, answer, facts):
    """X2 in set form: answer numbers with no equal number among the case's facts.

    Values are compared by their sixth decimal; its neighbours are probed too,
    so that the tolerance is the same as in the row form. Beyond 1e12 doubles lie
    further apart than the tolerance, so there only equal values match."""
    def tokens(text):
        toks = cases.select(key, F.explode(F.array_distinct(N.number_tokens(text))).alias("tok"))
        return toks.withColumns({"val": N.num_value(F.col("tok")), "core": N.num_core(F.col("tok"))})

    def small(v):
        return F.abs(v) < 1e12

    def slot(v):
        return F.when(small(v), F.floor(F.when(small(v), v) * 1e6)).otherwise(F.xxhash64(v))

    said = tokens(answer).filter(F.when(
        F.col("val").isNotNull(), ~((F.floor("val") == F.col("val")) & (F.abs("val") < 10)))
        .otherwise(F.length(F.regexp_replace("tok", "[^0-9]", "")) >= 2))
    known = tokens(facts).select(key, "val", "core")
    probe = known.filter(F.col("val").isNotNull()).select(
        key, F.col("val").alias("fact"),
        F.explode(F.when(small(F.col("val")), F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: slot(F.col("val")) + i))
                  .otherwise(F.array(slot(F.col("val"))))).alias("slot"))
    values = said.filter(F.col("val").isNotNull()).withColumn("slot", slot(F.col("val")))
    backed = values.join(probe, [key, "slot"]).filter(F.abs(F.col("fact") - F.col("val")) < 1e-6) \
        .select(key, "tok").distinct()
    cores = known.filter(F.col("val").isNull()).select(key, "core").distinct()
    return (values.select(key, "tok").join(backed, [key, "tok"], "left_anti")
            .unionByName(said.filter(F.col("val").isNull())
                         .join(cores, [key, "core"], "left_anti").select(key, "tok")))


def capture_gate_asof(events, controls, cpu_max=70.0, limit=HOT_ROWS):
    """Events whose stream has, at their time, consent on, incognito off,
    CPU within the limit and no game in front.

    Events and control signals become one ordered stream; the state of each gate
    is its last known value.  Unset gates: no consent, nothing else in the way."""
    flow = controls.select("stream", "ts", "seq", "gate", "state", F.lit(0).alias("kind")).unionByName(
        events.select("stream", "ts", "seq", F.lit(None).cast("string").alias("gate"),
                      F.lit(None).cast("double").alias("state"), F.lit(1).alias("kind")))
    o = Ordered(flow, ["stream"], ["ts", "kind", "seq"], C.micros("ts"), limit)
    gates = ("consent", "incognito", "cpu", "game")
    o.last_known([(g, F.when(F.col("gate") == g, F.col("state"))) for g in gates])
    rows = o.result().filter(F.col("kind") == 1)

    def state(g):
        return F.coalesce(g, F.lit(0.0))

    return rows.withColumn("kept", (state("consent") > 0) & (state("incognito") == 0)
                           & (state("cpu") <= cpu_max) & (state("game") == 0)) \
        .select("stream", "ts", "seq", "kept")


def city_dimension(spark):
    return spark.createDataFrame(list(rules.CITY_BY_ZONE.items()), "zone string, city string")


def city_enrich(queries):
    """Look the zone up (a fixed table of some 45 rows) and add the city."""
    dim = F.broadcast(city_dimension(queries.sparkSession))
    return queries.join(dim, "zone", "left").withColumn(
        "term", K.enrich_with_city("term", "city", "question"))


def missed_summaries(spark, first_day, last_day, summaries, as_of, at="21:00"):
    """Days up to as_of without a summary though their hour has passed."""
    span = spark.range(1).select(F.explode(F.sequence(
        F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    due = F.concat(F.col("day").cast("string"), F.lit(f" {at}:00")).cast("timestamp_ntz")
    return span.filter(due <= as_of).join(summaries.select("day").distinct(), "day", "left_anti")


def previous_exchange(asks_with_answers, limit=HOT_ROWS):
    """For follow-ups, the previous exchange with its answer cut short."""
    o = Ordered(asks_with_answers, ["conv_id"], ["turn"], F.col("turn"), limit, grain=1)
    o.previous(["text", "answer"], "_prev")
    has = F.col("_prev").isNotNull()
    block = F.concat(F.lit("User: "), F.col("_prev.text"), F.lit("\nAssistant: "),
                     F.substring(F.coalesce("_prev.answer", F.lit("")), 1, 200))
    return o.result().withColumns({
        "followup": K.is_followup("text", has),
        "exchange": F.when(K.is_followup("text", has), block)}).drop("_prev")
