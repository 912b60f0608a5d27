"""Timeline operators: recent activity, snapshots, dialogue history, preferences."""

import uuid

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import payload as J
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators.ordered import HOT_ROWS, Ordered
from recollect.session import release, written

SHARED_BYTES = 16 << 20  # of aliases handed to every task
GRAM = 6                 # characters by which more aliases meet the texts
SERVICE_SCHEMA = "pos int, service string, label string, kind string, alias string"


def newest_first():
    return [F.col("time_start").desc(), F.col("seq").desc()]


def newest(df, n):
    """O1-O3: the newest n rows; a bounded top-n, never a full sort.

    The n-th newest time is found on the time column alone; only rows from there
    on are then read in full, so old files and row groups are skipped."""
    nth = (df.select("time_start").orderBy(F.col("time_start").desc()).limit(n)
           .agg(F.min("time_start")).first()[0])
    recent = df.filter(F.col("time_start") >= F.lit(nth).cast("timestamp_ntz"))
    return recent.orderBy(*newest_first()).limit(n)


def last_screen_snapshot(memory):
    """O1."""
    return newest(memory.filter(J.is_screen_app("app_name")), 1)


def last_n_screen_facts(memory, n):
    """O2."""
    return newest(memory.filter(J.is_screen_app("app_name")), n)


def recent_qa(memory, n):
    """O3."""
    return newest(memory.filter(F.col("app_name") == "dialogue"), n)


def activity_feed(memory, own_markers=()):
    """Screen rows without dialogue, notes and the tool's own windows."""
    app = F.lower("app_name")
    keep = J.is_screen_app("app_name") & ~app.isin(rules.NON_ACTIVITY_APPS)
    if own_markers:
        keep = keep & ~T.contains_any(app, own_markers) \
            & ~T.contains_any(F.lower("window_title"), own_markers)
    return memory.filter(keep)


def with_phrases(activity):
    """T9 and K4 on an activity feed."""
    return activity.withColumns({
        "phrase": T.activity_line("app_name", "window_title"),
        "category": K.activity_category("app_name", "window_title")})


def collapse_consecutive(activity, keys=(), limit=HOT_ROWS):
    """Drop a row whose phrase equals that of the newer row next to it.

    The timeline reads newest first, so of a run of equal phrases the newest
    row stays: a row is kept when the row after it in time differs."""
    rev = activity.withColumn("_down", -C.micros("time_start")).withColumn("_tie", -F.col("seq"))
    o = Ordered(rev, keys, ["_down", "_tie"], F.col("_down"), limit)
    o.previous(["phrase"], "_newer")
    return o.result().filter(
        F.col("_newer").isNull() | (F.col("_newer.phrase") != F.col("phrase"))
    ).drop("_newer", "_down", "_tie")


def iron_log(memory, n, as_of, zone="UTC", own_markers=(), limit=HOT_ROWS):
    """The newest n distinct-in-a-row phrases as log lines.

    Whether a row is kept depends on the next newer row only, so the newest m rows
    give the exact answer if they yield n lines; m grows until they do."""
    feed = activity_feed(memory, own_markers)

    def log(rows):
        kept = collapse_consecutive(with_phrases(rows), (), limit)
        line = F.concat(C.fmt_hm("time_start", zone), F.lit(" ("), C.rel_age("time_start", as_of),
                        F.lit(") — "), F.col("phrase"))
        return kept.orderBy(*newest_first()).limit(n).select("time_start", "seq", "category", line.alias("line"))

    m = 16 * n
    while True:
        rows = newest(feed, m)
        lines = log(rows)
        if lines.select("seq").count() >= n or rows.select("seq").count() < m:
            return lines
        m *= 16


def top_categories(log, n=2):
    """G14 on a bounded log: distinct categories by recency, first n joined."""
    first_seen = log.groupBy("category").agg(
        F.max(F.struct("time_start", "seq")).alias("_newest"))
    ranked = F.sort_array(F.collect_list(F.struct("_newest", "category")), asc=False)
    return first_seen.agg(F.array_join(F.slice(F.transform(
        ranked, lambda r: r["category"]), 1, n), " and ").alias("acts"))


def activity_summary(memory, n, as_of, zone="UTC", own_markers=()):
    """An opening sentence and n bullets, one row."""
    log = iron_log(memory, n, as_of, zone, own_markers)
    newest_first = F.sort_array(F.collect_list(F.struct("time_start", "seq", "category", "line")),
                                asc=False)
    one = log.agg(newest_first.alias("rows"))   # at most n rows
    cats = F.array_distinct(F.transform("rows", lambda r: r["category"]))
    intro = F.concat(C.when_word(F.get("rows", F.lit(0))["time_start"], as_of), F.lit(" you "),
                     F.array_join(F.slice(cats, 1, 2), " and "), F.lit(". Timeline:"))
    bullets = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("• "), r["line"])), "\n")
    empty = F.lit("No activity is stored for this time.")
    return one.select(F.when(F.size("rows") == 0, empty).otherwise(
        F.concat(intro, F.lit("\n"), bullets)).alias("summary"))


def service_dimension(spark, services=None):
    """One row per (service, alias), in registry order."""
    rows = [(i, sid, label, kind, alias)
            for i, (sid, label, kind, aliases) in enumerate(services or rules.SERVICES)
            for alias in aliases]
    return spark.createDataFrame(rows, SERVICE_SCHEMA)


def _haystack():
    return F.lower(F.concat("app_name", F.lit(" "), "window_title"))


def service_alias_join(activity, services=None):
    """Services whose alias occurs in the activity text, one row per pair.

    services: a table (pos, service, label, kind, alias) of any size, or a short list, which
    becomes one array literal per row and an explode; no join and no shuffle."""
    hay = _haystack()
    if isinstance(services, DataFrame):
        return alias_hits(activity, hay, services)
    hits = F.array_compact(F.array(*[
        F.when(T.contains_any(hay, aliases),
               F.struct(F.lit(i).alias("pos"), F.lit(sid).alias("service"),
                        F.lit(label).alias("label"), F.lit(kind).alias("kind")))
        for i, (sid, label, kind, aliases) in enumerate(services or rules.SERVICES)]))
    return activity.withColumn("_hit", F.explode(hits)).select("*", "_hit.*").drop("_hit")


def alias_hits(rows, text, aliases, share=SHARED_BYTES):
    """Rows with each entry (pos, service, label, kind) of a table that has an alias in `text`.

    Up to `share` bytes of aliases go to every task as one automaton, which finds all of them
    in one walk over a text. More meet the texts by a key and never pass the driver."""
    kinds = ["pos", "service", "label", "kind"]
    names = written(aliases.filter(F.length("alias") > 0).select(*kinds, "alias").distinct(), "aliases")
    size = names.agg(F.sum(F.octet_length("alias") + 16)).first()[0] or 0
    if size > share:
        return _hits_by_gram(rows, text, names, kinds)
    # The aliases pass the driver as Arrow columns: Python objects would take many times `share`.
    entries = written(names.select(*kinds).distinct().withColumn("_entry", F.monotonically_increasing_id()), "alias-entries")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in kinds]
    by_alias = names.alias("n").join(F.broadcast(entries).alias("e"), same).groupBy("alias").agg(
        F.collect_set("_entry").alias("places")).toArrow()  # at most `share` bytes
    if not by_alias.num_rows:
        return rows.limit(0).withColumns({k: F.lit(None).cast(aliases.schema[k].dataType) for k in kinds})
    found = _automaton(rows.sparkSession.sparkContext.broadcast(by_alias))
    return rows.withColumn("_entry", F.explode(found(text))).join(  # no more entries than aliases
        F.broadcast(entries), "_entry").drop("_entry")


def _grams(c, n):
    """Hashes (40 bits, as what meets is checked) of the runs of n characters of a text; none where it is shorter."""
    def of(chars):
        return F.when(F.size(chars) >= n, F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.xxhash64(
            *[F.get(chars, i + k) for k in range(n)]).bitwiseAND(F.lit((1 << 40) - 1)))).otherwise(F.array().cast("array<bigint>"))

    return T.let(F.split(c, ""), of)


def _hits_by_gram(rows, text, names, kinds):
    """Every alias has one gram of GRAM characters (or all it has), every distinct text its grams, and
    what meets is checked. Grams meet as hashes, texts only by their number. Aliases of the same
    entries are one class, whose entries a text gets once.

    Joins are sorted: a table whose shuffled bytes look small enough to be handed out takes many
    times as much in the driver."""
    def meet(a, b, on):
        return a.join(b.hint("merge"), on)

    texts = written(rows.select(text.alias("_hay")).filter(F.length("_hay") > 0).distinct().withColumn(
        "_text", F.monotonically_increasing_id()), "alias-texts")
    entry = [x for k in kinds for x in (F.col(k).isNull(), F.col(k))]
    alone = names.groupBy("alias").agg(*[F.bit_xor(F.xxhash64(F.lit(i), *entry)).alias(f"_c{i}") for i in range(2)])
    size = F.least(F.length("alias"), F.lit(GRAM))
    sizes = [r["n"] for r in names.select(size.alias("n")).distinct().collect()]  # at most GRAM numbers
    # The gram of an alias that the fewest aliases hold; which one is only a matter of speed.
    held = alone.select("alias", F.explode(F.array_distinct(F.coalesce(*[
        F.when(size == n, _grams(F.col("alias"), n)) for n in sizes]))).alias("_gram"))
    rare = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    key = meet(held, rare, "_gram").groupBy("alias").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    spark = rows.sparkSession
    keys = written(meet(key, alone, "alias"), "alias-keys")
    release(spark)  # what the keys were found by, before the texts are dealt out
    pieces = texts.select("_text", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("_hay"), n) for n in sizes])))).alias("_gram"))
    met = meet(meet(pieces, keys, "_gram").drop("_gram"), texts, "_text").filter(F.col("_hay").contains(F.col("alias")))
    classes = written(met.select("_text", "_c0", "_c1").distinct(), "alias-classes")
    release(spark)
    of_class = meet(names, keys.groupBy("_c0", "_c1").agg(F.min("alias").alias("alias")), "alias").drop("alias")
    hits = meet(classes, of_class, ["_c0", "_c1"]).select("_text", *kinds).distinct()
    return meet(meet(rows.withColumn("_hay", text), texts, "_hay").drop("_hay"), hits, "_text").drop("_text")


_MACHINES = {}  # the automaton this worker built last, by its name


def _machine(name, shared):
    """(automaton of row numbers, places of row i from starts[i] to starts[i + 1])"""
    if name not in _MACHINES:
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        aliases, places = (shared.value.column(c).combine_chunks() for c in ("alias", "places"))
        for i, alias in enumerate(aliases):
            machine.add_word(alias.as_py(), i)
        machine.make_automaton()
        _MACHINES.clear()
        _MACHINES[name] = machine, places.offsets.to_numpy(), places.values.to_numpy()
    return _MACHINES[name]


def _automaton(shared):
    """A column function: the places whose alias occurs in a text."""
    name = uuid.uuid4().hex

    @F.pandas_udf("array<bigint>")
    def found(texts: pd.Series) -> pd.Series:
        machine, starts, places = _machine(name, shared)

        def of(text):
            hits = {i for _, i in machine.iter(text)} if text else ()
            return np.unique(np.concatenate([places[starts[i]:starts[i + 1]] for i in hits])) if hits else []

        return texts.map(of)

    return found


def preferred_service(activity, want, keys=("stream",), window=300, services=None):
    """Per key, the service with the best recency-weighted score for a kind.

    A service of exactly that kind wins over one that serves both."""
    w = Window.partitionBy(*keys).orderBy(*newest_first())
    recent = activity.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= window)
    hits = service_alias_join(recent, services)
    fits = hits.filter(F.lit(want == "both") | F.col("kind").isin(want, "both"))
    scored = fits.groupBy(*keys, "pos", "service", "kind").agg(
        F.round(F.sum(1.0 / (1.0 + (F.col("_rn") - 1) * 0.03)), 9).alias("score"))
    best = Window.partitionBy(*keys).orderBy(
        (F.col("kind") == want).desc(), F.col("score").desc(), F.col("pos"))
    return (scored.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") == 1)
            .select(*keys, "service", "score"))


def most_recent_service(activity, keys=("stream",), services=None):
    """Per key, the first registered service matching the newest match."""
    if isinstance(services, DataFrame):
        hits = service_alias_join(activity, services)
        return hits.groupBy(*keys).agg(F.max_by("service", F.struct("time_start", "seq", -F.col("pos"))).alias("service"))
    hay = _haystack()
    svc = F.coalesce(*[F.when(T.contains_any(hay, aliases), F.lit(sid))
                       for sid, _, _, aliases in (services or rules.SERVICES)])
    return (activity.withColumn("service", svc).filter(F.col("service").isNotNull())
            .groupBy(*keys).agg(F.max_by("service", F.struct("time_start", "seq")).alias("service")))


def sessions(events, keys=("stream",), gap="30 minutes"):
    """Runs of events of a key without a pause of `gap`: first and last time, number of events.

    A batch, or a stream with a watermark on `_t` (see `streaming.jobs.sessions`). Spark merges
    sessions on the map side first, so a key with very many events sends few of them."""
    w = F.session_window("_t", gap)
    timed = events if "_t" in events.columns else events.withColumn("_t", F.col("time_start").cast("timestamp"))
    return timed.groupBy(*keys, w).agg(
        F.min("time_start").alias("first_ts"), F.max("time_start").alias("last_ts"), F.count(F.lit(1)).alias("n")).drop("session_window")


def history_messages(qa_rows, n=20):
    """The newest n stored pairs as user/ai rows, oldest first."""
    pair = J.parse_qa("text")
    rows = newest(qa_rows, n).withColumn("_qa", pair).filter(F.col("_qa").isNotNull())
    msgs = F.array(F.struct(F.lit(0).alias("pos"), F.lit("user").alias("role"),
                            F.col("_qa.question").alias("message")),
                   F.struct(F.lit(1).alias("pos"), F.lit("ai").alias("role"),
                            F.col("_qa.answer").alias("message")))
    return (rows.select("time_start", "seq", F.explode(msgs).alias("m")).select("time_start", "seq", "m.*")
            .filter(F.col("message") != "").orderBy("time_start", "seq", "pos"))


def daily_reminder_cap(reminders, cap=2):
    """The first `cap` distinct reminders of each day.

    Repeats collapse first (partial aggregation), so a busy day reaches the
    ranking as its distinct texts only."""
    once = reminders.groupBy("day", "reminder").agg(F.min(F.struct("ts", "seq")).alias("_first"))
    w = Window.partitionBy("day").orderBy("_first")
    return (once.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)
            .select("day", "reminder", F.col("_first.ts").alias("ts"), "rank"))


def with_turn_order(asks, limit=HOT_ROWS):
    return Ordered(asks, ["conv_id"], ["turn"], F.col("turn"), limit, grain=1)


def with_previous_question(asks, limit=HOT_ROWS):
    """The previous question of the same conversation, as `prev`."""
    o = with_turn_order(asks, limit)
    o.previous(["text"], "_prev")
    return o.result().withColumn("prev", F.col("_prev.text")).drop("_prev")


def backreference_resolve(asks, limit=HOT_ROWS):
    """Commands with the pronoun replaced by the last question's referent."""
    rows = with_previous_question(asks, limit).withColumn("referent", K.referent_of("prev"))
    return rows.withColumn("resolved", K.resolve_reference("text", F.col("referent")))


def entity_tracking(asks, max_facts=3, limit=HOT_ROWS):
    """Per conversation and entity episode, its latest name and facts.

    A subject other than the current name opens an episode; a rename keeps it;
    statements before any subject have nothing to attach to."""
    rows = asks.withColumns({"subject": K.entity_in_question("text"),
                             "stmt": K.entity_statement("text")})
    o = with_turn_order(rows, limit)
    o.last_known([("_seen", F.when(F.col("subject").isNotNull(), F.lit(True)))], inclusive=False)
    rename = F.when(F.col("_seen") & (F.col("stmt.kind") == "rename"), F.col("stmt.value"))
    o.df = o.df.withColumn("_name_here", F.coalesce("subject", rename))
    o.last_known([("_before", F.col("_name_here"))], inclusive=False)
    # A rename on the same row comes before its subject.
    current = F.coalesce(rename, F.col("_before"))
    opens = F.col("subject").isNotNull() & (
        current.isNull() | (F.lower(current) != F.lower("subject")))
    o.df = o.df.withColumn("_open", F.when(opens, F.col("turn")))
    o.last_known([("_prior", F.col("_open"))], inclusive=False)
    o.last_known([("episode", F.col("_open")), ("name", F.col("_name_here"))])
    tracked = o.result().filter(F.col("episode").isNotNull())
    names = tracked.groupBy("conv_id", "episode").agg(F.max_by("name", "turn").alias("name"))
    # A fact on a row that opens an episode was said about the one before it.
    fact = F.when((F.col("stmt.kind") == "fact") & (F.col("stmt.value") != ""), F.col("stmt.value"))
    about = F.when(F.col("_open").isNull(), F.col("episode")).otherwise(F.col("_prior"))
    said = (tracked.withColumn("fact", fact).withColumn("episode", about)
            .filter(F.col("fact").isNotNull() & F.col("episode").isNotNull())
            .groupBy("conv_id", "episode", F.lower("fact").alias("_key"))
            .agg(F.min(F.struct("turn", "fact")).alias("_first")))
    w = Window.partitionBy("conv_id", "episode").orderBy(F.col("_first.turn").desc())
    kept = (said.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_facts)
            .groupBy("conv_id", "episode")
            .agg(F.transform(F.array_sort(F.collect_list("_first")), lambda f: f["fact"]).alias("facts")))
    out = names.join(kept, ["conv_id", "episode"], "left")
    facts = F.coalesce(F.array_join("facts", " "), F.lit(""))
    return out.select("conv_id", "episode", "name", F.coalesce(F.array_join("facts", "; "), F.lit("")).alias("facts"),
                      F.when(facts == "", F.col("name")).otherwise(
                          F.concat("name", F.lit(" "), facts)).alias("search_term"))
