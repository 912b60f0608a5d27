"""Queries: nearest neighbours, context, joins, web pages."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators import approximate as A
from recollect.operators import context as P
from recollect.operators import joins as X
from recollect.operators import retrieval as R
from recollect.operators import rollup as G
from recollect.operators import timeline as W
from recollect.operators import web as H
from recollect.plans import sql as S
from recollect.plans.dedup import wordlist
from recollect.plans.registry import query
from recollect.plans.text import NUMS, VAL, CORE, audited, AUDITED
from recollect.plans.timeline import as_of, ACTIVITY, PHRASES, KEPT, LINE
from recollect.session import scratch_path
from recollect.sources import store
from recollect.sources import views as V

L = F.lit


def texts(spark, d):
    """Adds the texts to rows that were found."""
    return lambda rows: V.with_text(rows, spark, d)


def hour_vectors(spark, d):
    """Hour records with the vector of their newest row; `seq` is the hour."""
    m = V.memory(spark, d, vectors=True).withColumn("hour", C.hour_bucket("time_start"))
    return m.groupBy("hour").agg(
        F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        F.max_by("embedding", F.struct("time_start", "seq")).alias("embedding")).withColumnRenamed("hour", "seq")


def hour_texts(spark, d):
    """Adds the previews to hour records that were found, reading the texts of those hours only."""
    def add(rows):
        hours = rows.select(F.col("seq").alias("hour")).distinct()
        m = V.memory(spark, d).withColumn("hour", C.hour_bucket("time_start")).join(hours, "hour", "left_semi")
        found = G.hour_previews(V.with_text(m, spark, d)).select(F.col("hour").alias("seq"), "preview")
        return rows.join(found, "seq")
    return add


L1 = ("l1", """SELECT epoch_us(time_start) // 3600000000 AS seq, min(time_start) AS time_start,
   left(coalesce(string_agg(text, ' ' ORDER BY time_start, seq) FILTER (text <> ''), ''), 200) AS preview,
   arg_max(vec, time_start) AS vec FROM l0tv GROUP BY 1""".replace("min(time_start)", "min(l0tv.time_start)")
      .replace("epoch_us(time_start)", "epoch_us(l0tv.time_start)").replace("ORDER BY time_start, seq", "ORDER BY l0tv.time_start, l0tv.seq")
      .replace("arg_max(vec, time_start)", "arg_max(l0tv.vec, l0tv.time_start)"))


def near(name, src, k, cond="true", queries="questions"):
    """View of the k nearest rows of `src` for each question, by squared distance."""
    return (name, f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, seq) AS rank FROM (
   SELECT vd.query_id, m.seq, vd.dist FROM (SELECT seq, vec FROM {src} WHERE {cond}) m
   JOIN (SELECT a.query_id, b.vec_id AS vec, list_sum(list_transform(list_zip(a.embedding, b.embedding),
     lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS dist
     FROM {queries} a, embeddings b) vd ON vd.vec = m.vec)) WHERE rank <= {k}""")


@query("knn_filtered", S.with_views("questions", "l0v", near("n", "l0v", 10, "app_name <> 'clipboard'"), body="""
   SELECT query_id, seq, rank FROM n"""))
def knn_filtered(spark, d):
    hits = R.knn_filtered(V.memory(spark, d, vectors=True), V.questions(spark, d), 10,
                          F.col("app_name") != "clipboard")
    return hits.select("query_id", "seq", F.col("rank").cast("bigint").alias("rank"))


@query("approx_knn")
def approx_knn(spark, d):
    """About the ten nearest rows of every 50th vector; its recall is tested."""
    v = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    return A.approx_knn(v, v.filter(F.col("seq") % 50 == 0).select(F.col("seq").alias("query_id"), "embedding"), 10)


@query("find_relevant", S.with_views("questions", "l0tv", near("n", "l0tv", 5), body="""
   SELECT query_id, rank, md5(text) AS text FROM n JOIN l0tv USING (seq)"""))
def find_relevant(spark, d):
    hits = R.find_relevant(V.memory(spark, d, vectors=True), V.questions(spark, d), 5, texts(spark, d))
    return hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.md5("text").alias("text"))


@query("count_relevant", S.with_views("questions", body="""SELECT query_id,
   least(5, (SELECT count(*) FROM events)) AS raw, least(5, (SELECT count(DISTINCT epoch_us(ts) // 3600000000) FROM events)) AS rolled FROM questions"""))
def count_relevant(spark, d):
    return R.count_relevant(V.memory(spark, d, vectors=True), hour_vectors(spark, d), V.questions(spark, d))


T0, T1 = 1704844800, 1705708800   # 2024-01-10 and 2024-01-20, inclusive


def filtered_sql(near_view, cond):
    return S.with_views("questions", "l0tv", near_view, body=f"""SELECT query_id, pos, line FROM (SELECT query_id,
     row_number() OVER (PARTITION BY query_id ORDER BY time_start DESC, seq DESC) AS pos,
     '[' || {S.fmt_ts('time_start')} || '] [' || app_name || '] ' || left(text, 200) AS line
     FROM n JOIN l0tv USING (seq) WHERE {cond}) WHERE pos <= 10""")


COND = f"epoch_us(time_start) // 1000000 BETWEEN {T0} AND {T1} AND contains(lower(app_name), 'fire')"


@query("search_by_filter", filtered_sql(near("n", "l0tv", 40), COND))
def search_by_filter(spark, d):
    return R.search_by_filter(V.memory(spark, d, vectors=True), V.questions(spark, d), 10, T0, T1,
                              "Fire", details=texts(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


@query("search_by_filter_pre", filtered_sql(near("n", "(SELECT * FROM l0tv WHERE " + COND + ")", 10), "true"))
def search_by_filter_pre(spark, d):
    return R.search_by_filter(V.memory(spark, d, vectors=True), V.questions(spark, d), 10, T0, T1,
                              "Fire", "prefilter", texts(spark, d)).withColumn("pos", F.col("pos").cast("bigint"))


@query("archive_keyword_search", S.with_views("l0t", body=f"""SELECT time_start, '[' || {S.fmt_ts('time_start')} || '] ' || p AS line
   FROM (SELECT *, CASE seq % 97 WHEN 1 THEN '{{"app_name":5,"window_title":true,"text":12}}'
     WHEN 2 THEN '{{"app_name":"x","text":' || id ELSE left(text, 200) END AS p FROM l0t)
   WHERE contains(lower(p), 'tion') ORDER BY time_start DESC, seq DESC LIMIT 50"""))
def archive_keyword_search(spark, d):
    """Over an archive that was written first."""
    path = scratch_path(spark, "searched-archive")
    store.archive_write(V.payloads(spark, d), path, "2024-02-01")
    archive = store.archive_read(spark, path).withColumn("seq", F.col("id").cast("bigint"))
    return R.archive_keyword_search(archive, "Tion", 50)


def mixed_questions(spark, d):
    """Questions; every third asks about one's own screen."""
    q = V.questions(spark, d)
    return q.withColumn("text", F.when(F.col("query_id") % 3 == 0, F.concat(
        L("what did i do about "), "text")).otherwise(F.col("text")))


SMART = [near("n0", "l0tv", 8, queries="questions"), near("n1", "l1", 5, queries="questions"),
    ("logtext", f"""SELECT 'Screen activity (newest first):' || chr(10) || string_agg('- ' || line || chr(10), '' ORDER BY time_start DESC, seq DESC)
       || chr(10) AS block FROM (SELECT time_start, seq, {LINE} AS line FROM kept, clock ORDER BY time_start DESC, seq DESC LIMIT 8)"""),
    ("rolled", f"""SELECT query_id, 'Summaries (newest first):' || chr(10) || string_agg('[' || {S.fmt_ts('time_start')} || ' · ' || {S.rel_age('time_start', 'as_of')}
       || '] ' || preview || chr(10) || chr(10), '' ORDER BY time_start DESC, seq DESC) AS block FROM n1 JOIN l1 USING (seq), clock GROUP BY query_id"""),
    ("rawrows", f"""SELECT n0.query_id, m.*, CASE WHEN age < 3600 THEN (age // 60) || ' min ago' ELSE (age // 3600) || ' h ago' END AS age_tag,
       {S.has_any('m.text', rules.CODE_HINTS)} AS code
       FROM n0 JOIN (SELECT l0tv.*, (epoch_us(as_of) - epoch_us(time_start)) // 1000000 AS age FROM l0tv, clock) m USING (seq)
       WHERE (query_id % 3 = 0 OR app_name IN ('dialogue', 'note')) AND app_name NOT IN ('user', 'system')
       QUALIFY row_number() OVER (PARTITION BY n0.query_id ORDER BY m.time_start DESC, m.seq DESC) <= 5"""),
    ("raw", f"""SELECT query_id, chr(10) || '## Similar events' || chr(10) || string_agg('[' || {S.fmt_ts('time_start')} || '] [' || app_name || '] (' || age_tag || ')' || chr(10)
       || left(text, 500) || chr(10) || chr(10), '' ORDER BY time_start DESC, seq DESC) AS block FROM rawrows GROUP BY query_id"""),
    ("smart", f"""SELECT query_id, query_id % 3 = 0 AS want_screen, left(CASE WHEN query_id % 3 = 0 THEN logtext.block ELSE '' END
       || coalesce(rolled.block, '') || coalesce(raw.block, ''), 2500) AS context
       FROM questions LEFT JOIN rolled USING (query_id) LEFT JOIN raw USING (query_id), logtext""")]
RAG = ["questions", "l0", "l0tv", "clock", L1, ACTIVITY, *PHRASES, KEPT, *SMART]


def smart(spark, d):
    now = as_of(spark, d)
    log = W.iron_log(V.memory(spark, d), 8, now)
    block = R.screen_block(log, lambda: W.last_screen_snapshot(V.memory(spark, d, text=True)))
    return R.smart_rag(V.memory(spark, d, vectors=True), hour_vectors(spark, d), mixed_questions(spark, d), block, now,
                       texts(spark, d), hour_texts(spark, d))


@query("smart_rag", S.with_views(*RAG, body="SELECT query_id, want_screen, context FROM smart", once=True))
def smart_rag(spark, d):
    return smart(spark, d)


@query("topic_timeline_rag", S.with_views(*RAG, body="SELECT query_id, want_screen, context FROM smart", once=True))
def topic_timeline_rag(spark, d):
    return R.topic_timeline_rag(smart(spark, d), V.memory(spark, d, vectors=True), mixed_questions(spark, d), texts(spark, d))


@query("legacy_timeline", S.with_views("questions", "l0tv", near("n", "l0tv", 10), ("r", """SELECT n.query_id, m.*,
   row_number() OVER (PARTITION BY n.query_id ORDER BY m.time_start DESC, m.seq DESC) AS i FROM n JOIN l0tv m USING (seq)"""), body=f"""
   SELECT query_id, left('## Recent events' || chr(10) || string_agg('[' || {S.fmt_ts('time_start')} || '] ' || app_name || ' / ' || window_title || chr(10)
     || left(text, 500), chr(10) || chr(10) ORDER BY i) FILTER (i <= 3) || coalesce(chr(10) || chr(10) || '## Historical context' || chr(10)
     || left(string_agg(app_name || ' (' || window_title || '): ' || left(text, 120), chr(10) ORDER BY i) FILTER (i > 3), 300), ''), 2500) AS context
   FROM r GROUP BY query_id"""))
def legacy_timeline(spark, d):
    return R.legacy_timeline(V.memory(spark, d, vectors=True), V.questions(spark, d), details=texts(spark, d))


@query("embed_text", f"SELECT doc_id, 384 AS dims, len({S.words('text')}) AS counted FROM documents")
def embed_text(spark, d):
    """The entries of a vector add up to the words of its text."""
    v = R.embed_text(V.documents(spark, d).select("doc_id", "text"), "text")
    counted = F.aggregate("embedding", L(0.0), lambda s, x: s + x.cast("double")).cast("bigint")
    return v.select("doc_id", F.size("embedding").alias("dims"), counted.alias("counted"))


# --- joins --------------------------------------------------------------------

def two_sided(spark, d):
    """Question/answer pairs as memory and web text with stated versions."""
    qa = V.qa_pairs(spark, d)
    n = F.col("conv_id") * 10 + F.col("turn")
    return qa.select(
        n.alias("query_id"), F.col("question").alias("text"), (F.col("conv_id") % 4 == 0).alias("offline"),
        F.concat("question", L(" Version: "), (n % 7).cast("string"), L(".0 build "), (n % 3).cast("string"), L(" cost 5 ")).alias("memory"),
        F.concat("answer", L(" version "), (n % 5).cast("string"), L(".0 (build "), (n % 2).cast("string"), L(" abc 1 ")).alias("web"))


TWO = ("two", """SELECT n AS query_id, question AS text, conv_id % 4 = 0 AS offline, question || ' Version: ' || (n % 7) || '.0 build ' || (n % 3) || ' cost 5 ' AS memory,
   answer || ' version ' || (n % 5) || '.0 (build ' || (n % 2) || ' abc 1 ' AS web FROM (SELECT *, conv_id * 10 + turn AS n FROM qa)""")


def facts_view(name, column, src="two"):
    return (name, f"""SELECT query_id, k, arg_min(v, i) AS v FROM (SELECT query_id, {S.trim_alnum('lower(ws[i])')} AS k, ws[i + 1] AS v, i FROM (
     SELECT query_id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT query_id, {S.words(column)} AS ws FROM {src})))
     WHERE regexp_matches(v, '[0-9]') AND strlen(k) >= 4 GROUP BY query_id, k""")


CONFLICTS = ("conflicts", """SELECT a.query_id, a.k AS word, a.v AS local, b.v AS web FROM fa a JOIN fb b USING (query_id, k) WHERE a.v <> b.v
   QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY a.k) <= 5""")


@query("detect_conflicts", S.with_views("qa", TWO, facts_view("fa", "memory"), facts_view("fb", "web"), CONFLICTS, body="SELECT * FROM conflicts"))
def detect_conflicts(spark, d):
    return X.detect_conflicts(two_sided(spark, d), "query_id", "memory", "web").drop("rank")


@query("grounding_antijoin", S.with_views("qa", AUDITED, ("said", f"SELECT DISTINCT conv_id * 100 + turn AS k, unnest({NUMS.format(x='a')}) AS tok FROM audited"),
    ("known", f"SELECT DISTINCT conv_id * 100 + turn AS k, unnest({NUMS.format(x='f')}) AS tok FROM audited"), body=f"""
    SELECT k, tok FROM said s WHERE CASE WHEN {VAL.format(t='s.tok')} IS NOT NULL THEN NOT (floor({VAL.format(t='s.tok')}) = {VAL.format(t='s.tok')} AND abs({VAL.format(t='s.tok')}) < 10)
      AND NOT EXISTS (SELECT 1 FROM known n WHERE n.k = s.k AND abs({VAL.format(t='n.tok')} - {VAL.format(t='s.tok')}) < 1e-6)
      ELSE length(regexp_replace(s.tok, '[^0-9]', '', 'g')) >= 2 AND NOT EXISTS (SELECT 1 FROM known n WHERE n.k = s.k AND {VAL.format(t='n.tok')} IS NULL
        AND {CORE.format(t='n.tok')} = {CORE.format(t='s.tok')}) END"""))
def grounding_antijoin(spark, d):
    a = audited(spark, d).withColumn("k", F.col("conv_id") * 100 + F.col("turn"))
    return X.grounding_antijoin(a.withColumn("a", T.extract_answer("raw")), "k", "a", "facts")


@query("capture_gate_asof", S.with_views("controls", ("flow", """SELECT stream, ts, seq, gate, state, 0 AS kind FROM controls
   UNION ALL SELECT user_id, ts, event_id, NULL, NULL, 1 FROM events WHERE event_type = 'click'"""), ("st", "SELECT *, " + ", ".join(
    f"last_value(CASE WHEN gate = '{g}' THEN state END IGNORE NULLS) OVER w AS {g}" for g in ("consent", "incognito", "cpu", "game"))
    + " FROM flow WINDOW w AS (PARTITION BY stream ORDER BY ts, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), body="""
   SELECT stream, ts, seq, coalesce(consent, 0) > 0 AND coalesce(incognito, 0) = 0 AND coalesce(cpu, 0) <= 70 AND coalesce(game, 0) = 0 AS kept
   FROM st WHERE kind = 1"""))
def capture_gate_asof(spark, d):
    e = V.table(spark, d, "events").filter(F.col("event_type") == "click")
    return X.capture_gate_asof(e.select(F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("seq")),
                               V.controls(spark, d))


ZONES = list(rules.CITY_BY_ZONE)


@query("city_enrich", S.with_views("asks", ("dim", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {S.lit(c)})" for i, c in enumerate(rules.CITY_BY_ZONE.values())) + f") AS t(i, city)"), body=f"""
   SELECT conv_id, turn, CASE WHEN city IS NOT NULL AND {S.has_any('lower(text)', rules.LOCATION_WORDS)} AND NOT contains(lower(text), lower(city))
     THEN text || ' ' || city ELSE text END AS term FROM asks LEFT JOIN dim ON i = conv_id % {len(ZONES) + 3}"""))
def city_enrich(spark, d):
    zone = F.get(F.array(*[L(z) for z in ZONES], L("Nowhere"), L("Nowhere"), L("Nowhere")),
                 (F.col("conv_id") % (len(ZONES) + 3)).cast("int"))
    a = V.asks(spark, d).select("conv_id", "turn", F.col("text").alias("term"), F.col("text").alias("question"),
                                zone.alias("zone"))
    return X.city_enrich(a).select("conv_id", "turn", "term")


@query("missed_summaries", S.with_views("clock", body="""SELECT day::VARCHAR AS day FROM (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events), clock
   WHERE day + INTERVAL 21 HOUR <= as_of AND day NOT IN (SELECT ts::DATE FROM events WHERE event_type = 'signup' AND value > 250)"""))
def missed_summaries(spark, d):
    e = V.table(spark, d, "events")
    lo, hi = e.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    made = e.filter((F.col("event_type") == "signup") & (F.col("value") > 250)).select(F.to_date("ts").alias("day"))
    return X.missed_summaries(spark, lo, hi, made, as_of(spark, d)).select(F.col("day").cast("string").alias("day"))


@query("qa_context_join", S.with_views("asks", "qa", ("p", """SELECT a.*, q.answer, lag(a.text) OVER w AS pt, lag(coalesce(q.answer, '')) OVER w AS pa
   FROM asks a LEFT JOIN qa q ON q.conv_id = a.conv_id AND q.turn = a.of_turn WINDOW w AS (PARTITION BY a.conv_id ORDER BY a.turn)"""), body=f"""
   SELECT conv_id, turn, CASE WHEN pt IS NOT NULL AND list_bool_or(list_transform({S.words('lower(text)')},
     lambda w: {S.isin(S.trim_alnum('w'), rules.REFERENCE_WORDS)})) THEN 'User: ' || pt || chr(10) || 'Assistant: ' || left(pa, 200) ELSE '' END AS exchange FROM p"""))
def qa_context_join(spark, d):
    qa = V.qa_pairs(spark, d).select("conv_id", F.col("turn").alias("of_turn"), "answer")
    rows = X.previous_exchange(V.asks(spark, d).join(qa, ["conv_id", "of_turn"], "left"))
    return rows.select("conv_id", "turn", F.coalesce("exchange", L("")).alias("exchange"))


# --- context ------------------------------------------------------------------

CLEAN = """array_to_string(list_transform(list_filter(string_split(regexp_replace(memory, '[^\\p{L}0-9 \\n\\t.,;:!?\\-—()"''«»/\\\\@#%&+=<>_]', '', 'g'), chr(10)),
  lambda l: NOT starts_with(ltrim(l), '##')), lambda l: replace(replace(replace(l, 'SCREEN ', ''), '(level 1+)', ''), 'level 1+', '')), chr(10))"""


def hybrid(spark, d):
    """Every second question calls for the web by its wording."""
    two = two_sided(spark, d)
    text = F.when(F.col("query_id") % 2 == 0, F.concat(L("what is the price of "), F.col("query_id").cast("string"))) \
        .otherwise(F.concat(L("explain "), F.col("query_id").cast("string")))
    q = two.select("query_id", text.alias("text"), "offline")
    return P.hybrid_context(q, two.select("query_id", "memory"), two.select("query_id", "web"))


HYBRID = ("hybrid", """SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'what is the price of ' || query_id ELSE 'explain ' || query_id END AS text,
   offline, memory, CASE WHEN query_id % 2 = 0 THEN web ELSE '' END AS web FROM two""")


@query("hybrid_context_union", S.with_views("qa", TWO, HYBRID, body="SELECT query_id, md5(memory) AS memory, md5(web) AS web FROM hybrid"))
def hybrid_context_union(spark, d):
    return hybrid(spark, d).select("query_id", F.md5("memory").alias("memory"), F.md5("web").alias("web"))


CLEANED = ("cleaned", f"SELECT query_id, text, {CLEAN} AS memory, web FROM hybrid")
CLOCK_LINE = """'Local time: ' || strftime(as_of, '%d.%m.%Y %H:%M') || ' (by the clock; says nothing about when the model was made).'"""
BUNDLED = ("bundled", f"""SELECT query_id, text, concat_ws(chr(10) || chr(10), {CLOCK_LINE}, CASE WHEN memory <> '' THEN 'From the screen:' || chr(10) || memory END,
   CASE WHEN web <> '' THEN 'From the web:' || chr(10) || web END, notice) AS bundle FROM cleaned LEFT JOIN (
     SELECT query_id, 'Screen and web disagree: ' || string_agg('«' || word || '»: local=' || local || ', web=' || web, '; ' ORDER BY word)
       || '. Name both values.' AS notice FROM conflicts GROUP BY query_id) USING (query_id), clock""")
BUNDLE = ["qa", "clock", TWO, HYBRID, CLEANED, facts_view("fa", "memory", "cleaned"), facts_view("fb", "web", "cleaned"), CONFLICTS, BUNDLED]


@query("context_bundle", S.with_views(*BUNDLE, body="SELECT query_id, bundle FROM bundled"))
def context_bundle(spark, d):
    return P.context_bundle(hybrid(spark, d), as_of(spark, d), wordlist(spark, d)).select("query_id", "bundle")


@query("prompt_table", S.with_views(*BUNDLE, body="""SELECT query_id, '<|im_start|>system' || chr(10) || 'Answer briefly.<|im_end|>' || chr(10)
   || '<|im_start|>user' || chr(10) || '<context>' || chr(10) || '[USER PROFILE]' || chr(10) || 'Name: Ann' || chr(10) || chr(10) || left(bundle, 2500) || chr(10)
   || '</context>' || chr(10) || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM bundled"""))
def prompt_table(spark, d):
    b = P.context_bundle(hybrid(spark, d), as_of(spark, d), wordlist(spark, d))
    return P.prompt_table(b, "Answer briefly.", "[USER PROFILE]\nName: Ann").select("query_id", "prompt")


def answered(spark, d):
    """Model replies with a figure that only some web texts back."""
    n = F.col("conv_id") * 10 + F.col("turn")
    return V.qa_pairs(spark, d).select(
        n.alias("query_id"), F.concat(L("what is Zorblat "), n.cast("string")).alias("text"),
        F.concat(L("<think>a</think><answer>"), "answer", L(" It cost 4200 活 units</answer>")).alias("raw"),
        F.when(n % 3 == 0, L("")).otherwise(F.col("question")).alias("memory"),
        F.when(n % 4 == 0, L("")).when(n % 4 == 1, F.concat("answer", L(" 4,200 zorblat"))).otherwise(F.col("answer")).alias("web"))


@query("answer_postprocess", S.with_views("qa", ("a", """SELECT conv_id * 10 + turn AS query_id, (conv_id * 10 + turn) % 4 AS m, question, answer FROM qa"""),
    ("l", f"SELECT query_id, {S.trim('line')} AS line, min(i) AS i FROM (SELECT query_id, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM a) WHERE {S.trim('line')} <> '' GROUP BY 1, 2"),
    ("b", "SELECT query_id, string_agg(line, chr(10) ORDER BY i) AS body FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 8) GROUP BY 1"), body=f"""
    SELECT query_id, CASE WHEN m IN (2, 3) THEN {S.lit(rules.NOTICE_UNVERIFIED)} || chr(10) || chr(10) || body ELSE answer || ' It cost 4200  units' END
      || CASE WHEN m = 1 THEN '' ELSE chr(10) || chr(10) || {S.lit(rules.CAVEAT)} END AS answer FROM a LEFT JOIN b USING (query_id)"""))
def answer_postprocess(spark, d):
    return P.answer_postprocess(answered(spark, d)).select("query_id", "answer")


SKIP = S.lit(rules.SKIP_ANSWER_START)


@query("dialogue_persist", S.with_views("qa", ("short", """SELECT ts, question, CASE WHEN turn % 4 = 2 THEN """ + SKIP + """ || ' ' || answer ELSE answer END AS answer FROM qa
   UNION ALL SELECT ts, question, left(answer, 12) FROM qa WHERE conv_id % 5 = 0"""), body=f"""SELECT time_start, md5('Q: ' || question || chr(10) || 'A: ' || answer) AS text,
   'dialogue' AS app_name FROM (SELECT ts AS time_start, question, answer FROM short)
   WHERE strlen(answer) >= 20 AND NOT starts_with(answer, {SKIP})"""))
def dialogue_persist(spark, d):
    """Whole answers, some of them refusals, and short ones beside them, stored and read back."""
    a = F.when(F.col("turn") % 4 == 2, F.concat(L(rules.SKIP_ANSWER_START + " "), "answer")).otherwise(F.col("answer"))
    qa = V.qa_pairs(spark, d)
    rows = qa.withColumn("answer", a).unionByName(qa.filter(F.col("conv_id") % 5 == 0).withColumn("answer", F.substring("answer", 1, 12)))
    said = P.dialogue_persist(rows).select("ts", "text", F.col("app_name").alias("source"), F.col("window_title").alias("event_type"))
    path = scratch_path(spark, "dialogue")
    store.add_events(said, path)
    return store.read_events(spark, path).select("time_start", F.md5("text").alias("text"), "app_name")


ACT7 = ("act7", """SELECT string_agg(line, chr(10) ORDER BY n DESC, app_name) AS activity FROM (SELECT app_name, n, '- ' || app_name || ' (' || n || ' events)'
     || coalesce(': "' || left(snippet, 80) || '"', '') AS line FROM (SELECT app_name, count(*) AS n,
       arg_min(text, (time_start, seq)) FILTER (strlen(text) > 10) AS snippet FROM l0t, clock
       WHERE time_start >= date_trunc('day', as_of) - INTERVAL 6 DAY AND app_name NOT IN ('clipboard', 'system', 'analyst', 'user', 'dialogue') GROUP BY 1))""")


@query("report_document", S.with_views("l0t", "clock", ACT7, body=f"""SELECT 'Activity report — the last 7 days' AS title,
   {S.trim('activity')} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Source — what was actually recorded' || chr(10) || chr(10) || activity AS document FROM act7"""))
def report_document(spark, d):
    return P.report_document(V.memory(spark, d, text=True), as_of(spark, d), 7)


@query("daily_summary_record", S.with_views("l0t", body="""SELECT day, '[DAILY SUMMARY — ' || day || ']' || chr(10) || left(string_agg(line, chr(10) ORDER BY n DESC, app_name), 1500) AS record FROM (
   SELECT day, app_name, n, '- ' || app_name || ' (' || n || ' events)' || coalesce(': "' || left(snippet, 80) || '"', '') AS line FROM (
     SELECT strftime(time_start, '%Y-%m-%d') AS day, app_name, count(*) AS n, arg_min(text, (time_start, seq)) FILTER (strlen(text) > 10) AS snippet FROM l0t
     WHERE app_name NOT IN ('clipboard', 'system', 'analyst', 'user', 'dialogue') GROUP BY 1, 2)) GROUP BY day"""))
def daily_summary_record(spark, d):
    return P.daily_summary_record(V.memory(spark, d, text=True))


# --- web pages ------------------------------------------------------------------

def result_pages(spark, d):
    """Stored pages with search results appended: containers on two pages in
    three, the flat layout on every second page."""
    p = V.pages(spark, d)
    pid = F.col("page_id").cast("string")
    box = F.concat(L('<div class="x result"><a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode("url"),
                   L('&amp;rut=1"> Page <b>'), pid, L('</b> &amp; more </a><p class="result__snippet">About '), pid,
                   L('</p></div><div class="result"></div><div class="result"><a class="result__a" href="//vk.com/'), pid,
                   L('">VK</a></div><div class="result"><a class="result__a" href="//a.org/'), pid, L('">Second</a></div>'))
    flat = F.concat(L('<table><tr><td><a class="result-link" href="'), "url", L('">Flat '), pid,
                    L('</a></td></tr><tr><td class="result-snippet"> Snip </td></tr><tr><td><a class="result-link" href="//b.org">Two</a></td></tr></table>'))
    return p.select("page_id", "url", F.when(F.col("page_id") % 4 == 0, L("vk pages")).otherwise(L("pages")).alias("question"),
                    F.concat("html", F.when(F.col("page_id") % 3 != 0, box).otherwise(L("")),
                             F.when(F.col("page_id") % 2 == 0, flat).otherwise(L(""))).alias("html"))


GROUPED = ("grouped", """SELECT page_id, 1 AS pos, 'Page ' || page_id || ' & more' AS title, url AS url, 'About ' || page_id AS snippet FROM pages WHERE page_id % 3 <> 0
   UNION ALL SELECT page_id, 2, 'VK', 'https://vk.com/' || page_id, '' FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 = 0
   UNION ALL SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 3 ELSE 2 END, 'Second', 'https://a.org/' || page_id, '' FROM pages WHERE page_id % 3 <> 0""")
FLAT = ("flat", """SELECT page_id, 1 AS pos, 'Flat ' || page_id AS title, url, 'Snip' AS snippet FROM pages WHERE page_id % 2 = 0
   UNION ALL SELECT page_id, 2, 'Two', 'https://b.org', '' FROM pages WHERE page_id % 2 = 0""")
BEST = ("best", "SELECT * FROM grouped UNION ALL SELECT * FROM flat WHERE page_id % 3 = 0")


def exploded(df):
    return df.select("page_id", F.posexplode("results").alias("pos", "r")).select(
        "page_id", (F.col("pos") + 1).alias("pos"), "r.title", "r.url", "r.snippet")


@query("extract_results", S.with_views(GROUPED, body="SELECT page_id, pos, title, url, snippet FROM grouped"))
def extract_results(spark, d):
    return exploded(H.extract_results(result_pages(spark, d), "question"))


@query("extract_results_flat", S.with_views(FLAT, body="SELECT page_id, pos, title, url, snippet FROM flat"))
def extract_results_flat(spark, d):
    return exploded(H.extract_results_flat(result_pages(spark, d), "question"))


@query("fallback_source", S.with_views(GROUPED, FLAT, BEST, body="SELECT page_id, pos, title, url, snippet FROM best"))
def fallback_source(spark, d):
    return exploded(H.fallback_source(result_pages(spark, d), "question"))


@query("snippet_lines", S.with_views(GROUPED, FLAT, BEST, body="""SELECT page_id, string_agg(pos || '. ' || title || ': ' || snippet || chr(10), '' ORDER BY pos) AS lines
   FROM best GROUP BY page_id"""))
def snippet_lines(spark, d):
    r = H.fallback_source(result_pages(spark, d), "question").filter(F.size("results") > 0)
    return r.select("page_id", H.snippet_lines("results").alias("lines"))


@query("sources_top3", S.with_views(GROUPED, FLAT, BEST, body="""SELECT page_id, chr(10) || chr(10) || 'Sources:' || chr(10)
   || string_agg('- [' || title || '](' || url || ')', chr(10) ORDER BY pos) AS sources FROM best WHERE pos <= 3 AND starts_with(url, 'http') GROUP BY page_id"""))
def sources_top3(spark, d):
    return H.sources_top3(exploded(H.fallback_source(result_pages(spark, d), "question")), "page_id")


def links(spark, d):
    """Anchors of the stored pages, some of them redirects."""
    a = V.pages(spark, d).select("page_id", "url", F.explode(F.regexp_extract_all("html", L('href="([^"]*)"'), 1)).alias("href"))
    return a.withColumn("href", F.when(F.col("page_id") % 3 == 0, F.concat(
        L("//r.example/?a=1&uddg=https%3A%2F%2Fvk.com%2Fp+q%20"), F.url_encode("url"), L("&z=2")))
        .when(F.col("page_id") % 3 == 1, F.concat(L(" //vk.com"), "href")).otherwise(F.col("href")))


LINKS = ("links", """SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '//r.example/?a=1&uddg=...' WHEN 1 THEN ' //vk.com' || h ELSE h END AS href,
   CASE page_id % 3 WHEN 0 THEN 'https://vk.com/p+q ' || url WHEN 1 THEN 'https://vk.com' || h ELSE h END AS real
   FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)""")


@query("decode_redirect", S.with_views(LINKS, body="SELECT page_id, real AS link, count(*) AS n FROM links GROUP BY ALL"))
def decode_redirect(spark, d):
    return links(spark, d).groupBy("page_id", H.decode_redirect("href").alias("link")).agg(F.count(L(1)).alias("n"))


@query("domain_filter", S.with_views(LINKS, body="SELECT page_id, count(*) AS n FROM links WHERE page_id % 4 = 0 OR page_id % 3 = 2 GROUP BY page_id"))
def domain_filter(spark, d):
    l = links(spark, d).withColumn("question", F.when(F.col("page_id") % 4 == 0, L("VK people")).otherwise(L("people")))
    return H.domain_filter(l, "href", "question").groupBy("page_id").agg(F.count(L(1)).alias("n"))


@query("first_video_id", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lpad(page_id::VARCHAR, 11, '-') ELSE 'none' END AS video FROM pages")
def first_video_id(spark, d):
    html = F.concat("html", F.when(F.col("page_id") % 2 == 0, F.concat(
        L('{"videoId":"'), F.lpad(F.col("page_id").cast("string"), 11, "-"), L('","videoId":"zzzzzzzzzzz"}')))
        .otherwise(L('"videoId":"short"')))
    return V.pages(spark, d).select("page_id", F.coalesce(H.first_video_id(html), L("none")).alias("video"))
