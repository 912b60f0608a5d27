"""Queries: text, time, number and payload functions, classification and jobs."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import classify as K
from recollect.functions import numbers as N
from recollect.functions import payload as J
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators import jobs as Q
from recollect.operators import rollup as G
from recollect.operators import timeline as W
from recollect.plans import sql as S
from recollect.plans.registry import query
from recollect.plans.timeline import ACTIVITY, PHRASES, as_of
from recollect.sources import views as V


def doc_md5(spark, d, text, fn):
    """A text function over every document; results compared by digest."""
    docs = V.documents(spark, d).withColumn("_in", T.col(text))
    return docs.select("doc_id", F.md5(fn("_in")).alias("result"))


def doc_sql(text, result, *more):
    return S.with_views(("d", f"SELECT doc_id, {text} AS x FROM documents"), *more,
                        body=f"SELECT doc_id, md5({result}) AS result FROM d")


def pick(n, *values):
    """CASE doc_id % n over the given columns."""
    values = [T.col(v) for v in values]
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col("doc_id") % n == i, v).otherwise(out)
    return out


L = F.lit
TEXT = "text"
LINES = "list_filter(list_transform(string_split(x, chr(10)), lambda l: " + S.trim("l") + "), lambda l: l <> '')"


@query("clean_lines", doc_sql("text || chr(10) || '  ' || chr(9) || chr(10) || ' end '", f"array_to_string({LINES}, chr(10))"))
def clean_lines(spark, d):
    return doc_md5(spark, d, F.concat(TEXT, L("\n  \t\n end ")), T.clean_lines)


NOISE_SQL = "regexp_replace(x, '[^\\p{L}0-9 \\n\\t.,;:!?\\-—()\"''«»/\\\\@#%&+=<>_]', '', 'g')"


@query("clean_noise_chars", doc_sql("text || ' • □ ★ [a] {b} $5'", NOISE_SQL))
def clean_noise_chars(spark, d):
    return doc_md5(spark, d, F.concat(TEXT, L(" • □ ★ [a] {b} $5")), T.clean_noise_chars)


MARKED_SQL = "'## Recent' || chr(10) || 'SCREEN ' || source || chr(10) || text || chr(10) || 'tail (level 1+) x' || chr(10) || '  ## gone'"


@query("strip_markers", doc_sql(MARKED_SQL, """array_to_string(list_transform(list_filter(string_split(x, chr(10)),
   lambda l: NOT starts_with(ltrim(l), '##')), lambda l: replace(replace(replace(l, 'SCREEN ', ''), '(level 1+)', ''), 'level 1+', '')), chr(10))"""))
def strip_markers(spark, d):
    return doc_md5(spark, d, F.concat(L("## Recent\nSCREEN "), F.col("source"), L("\n"), TEXT,
                                      L("\ntail (level 1+) x\n  ## gone")), T.strip_markers)


@query("strip_cjk", doc_sql("text || ' 活动テ한ａ' || lang || '。'", "text || ' ' || lang").replace(
    "SELECT doc_id, text || ' 活动テ한ａ' || lang || '。' AS x FROM documents", "SELECT * FROM documents"))
def strip_cjk(spark, d):
    return doc_md5(spark, d, F.concat(TEXT, L(" 活动テ한ａ"), F.col("lang"), L("。")), T.strip_cjk)


@query("text_summary", S.with_views("l0t", body="""SELECT id, md5(CASE WHEN window_title = '' THEN '[SCREEN] ' || app_name
   ELSE '[SCREEN] ' || window_title || ' (' || app_name || ')' END || CASE WHEN seq % 3 <> 0 AND text <> '' THEN chr(10) || text
   WHEN window_title = '' THEN ': active window' ELSE '' END) AS result FROM l0t"""))
def text_summary(spark, d):
    m = V.memory(spark, d, text=True)
    body = F.when(F.col("seq") % 3 != 0, F.col("text"))
    return m.select("id", F.md5(T.text_summary("window_title", "app_name", body)).alias("result"))


def code_docs(spark, d):
    """Documents set as code: sentences become statements inside a function."""
    return V.documents(spark, d).withColumn("text", pick(
        3, TEXT, F.concat(L("pub fn "), F.col("source"), L("() {\n"), F.replace(TEXT, L(". "), L(";\n")),
                          L("\n}}\n  fn inner() { x }\nstruct S { a }\n")),
        F.concat(L("def f():\n"), F.replace(TEXT, L("\n"), L("\n}\n{ ")))))


CODE_DOCS = ("code_docs", """SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN text
   WHEN 1 THEN 'pub fn ' || source || '() {' || chr(10) || replace(text, '. ', ';' || chr(10)) || chr(10) || '}}' || chr(10)
     || '  fn inner() { x }' || chr(10) || 'struct S { a }' || chr(10)
   ELSE 'def f():' || chr(10) || replace(text, chr(10), chr(10) || '}' || chr(10) || '{ ') END AS text FROM documents""")
CODE_LINES = ("code_lines", f"""SELECT *, sum(delta) OVER w AS s FROM (SELECT doc_id, line, i, {S.trim('line')} AS t,
   (length(line) - length(replace(line, '{{', ''))) - (length(line) - length(replace(line, '}}', ''))) AS delta FROM (
     SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
       SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM code_docs)))
   WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
CODE_DEPTH = ("code_depth", """SELECT *, s_before - least(0, min(s_before) OVER (PARTITION BY doc_id ORDER BY i)) AS depth
   FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY i), 0) AS s_before FROM code_lines)""")
SKELETON = ("skeleton", f"""SELECT c.doc_id, c.source, c.text, CASE WHEN {S.has_any('c.text', rules.CODE_HINTS)}
   THEN left(coalesce(k.body, ''), 2000) ELSE left(c.text, 500) END AS kept FROM code_docs c LEFT JOIN (
     SELECT doc_id, string_agg(line || chr(10), '' ORDER BY i) AS body FROM code_depth
     WHERE depth = 0 OR t = '' OR {S.starts('t', rules.CODE_KEEP_PREFIXES)} GROUP BY doc_id) k USING (doc_id)""")


@query("summarize_code", S.with_views(CODE_DOCS, CODE_LINES, CODE_DEPTH, SKELETON, body="SELECT doc_id, md5(kept) AS result FROM skeleton"))
def summarize_code(spark, d):
    return code_docs(spark, d).select("doc_id", F.md5(T.summarize_code("text")).alias("result"))


@query("code_skeletons", S.with_views(CODE_DOCS, CODE_LINES, CODE_DEPTH, SKELETON, body="""SELECT source, count(*) AS docs,
   sum(length(text))::BIGINT AS chars, sum(length(kept))::BIGINT AS kept_chars,
   round(sum(length(kept)) / sum(length(text)), 6)::DOUBLE AS ratio FROM skeleton GROUP BY source"""))
def code_skeletons(spark, d):
    return Q.code_skeletons(code_docs(spark, d))


# --- windows and titles ----------------------------------------------------------

def titles(spark, d):
    """Window titles around a document's whole text, in the shapes apps use."""
    subj = F.col(TEXT)
    app = pick(5, L("chrome"), L("Code"), L("explorer.exe"), L("PyCharm"), L("Slack"))
    title = pick(6, F.concat(L("(7) "), subj, L(" - YouTube - Google Chrome")), F.concat(subj, L(" | Reddit")),
                 L("GitHub"), F.concat(subj, L(" — "), F.col("lang"), L(" - Visual Studio Code")), L(""),
                 F.concat(subj, L(" – Wikipedia — Mozilla Firefox")))
    return V.documents(spark, d).select("doc_id", app.alias("app_name"), title.alias("window_title"))


TITLES = ("titles", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'chrome' WHEN 1 THEN 'Code' WHEN 2 THEN 'explorer.exe'
   WHEN 3 THEN 'PyCharm' ELSE 'Slack' END AS app_name, CASE doc_id % 6 WHEN 0 THEN '(7) ' || subj || ' - YouTube - Google Chrome'
   WHEN 1 THEN subj || ' | Reddit' WHEN 2 THEN 'GitHub' WHEN 3 THEN subj || ' — ' || lang || ' - Visual Studio Code'
   WHEN 4 THEN '' ELSE subj || ' – Wikipedia — Mozilla Firefox' END AS window_title
   FROM (SELECT *, text AS subj FROM documents)""")
TITLE_PHRASES = S.phrase_views("titles")


@query("strip_leading_count", S.with_views(TITLES, body="""SELECT doc_id,
   md5(CASE WHEN doc_id % 6 = 0 THEN substring(window_title, 5) ELSE window_title END) AS result FROM titles"""))
def strip_leading_count(spark, d):
    return titles(spark, d).select("doc_id", F.md5(T.strip_leading_count("window_title")).alias("result"))


@query("title_segments", S.with_views(TITLES, *TITLE_PHRASES, body="SELECT doc_id, md5(array_to_string(segs, ' ~ ')) AS result FROM phrases"))
def title_segments(spark, d):
    return titles(spark, d).select("doc_id", F.md5(F.array_join(T.title_segments("window_title"), " ~ ")).alias("result"))


@query("activity_line", S.with_views(TITLES, *TITLE_PHRASES, body="SELECT doc_id, md5(phrase) AS phrase FROM phrases"))
def activity_line(spark, d):
    return titles(spark, d).select("doc_id", F.md5(T.activity_line("app_name", "window_title")).alias("phrase"))


@query("activity_category", S.with_views(TITLES, *TITLE_PHRASES, body="SELECT category, count(*) AS n FROM phrases GROUP BY ALL"))
def activity_category(spark, d):
    c = titles(spark, d).withColumn("category", K.activity_category("app_name", "window_title"))
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


STEM = f"left(array_to_string({S.words('regexp_replace(x, {q}[^{bs}p{{{{L}}}}{bs}p{{{{N}}}} _-]{q}, {q} {q}, {q}g{q})'.format(q=chr(39), bs=chr(92)))}, ' '), 50)".replace("{{", "{").replace("}}", "}")


@query("sanitize_stem", doc_sql("CASE WHEN doc_id % 7 = 0 THEN '../:*?' ELSE '../' || text END",
                                f"CASE WHEN trim({STEM}) = '' THEN 'idea' ELSE trim({STEM}) END"))
def sanitize_stem(spark, d):
    return doc_md5(spark, d, pick(7, L("../:*?"), F.concat(L("../"), TEXT)), T.sanitize_stem)


@query("report_title", S.with_views(("d", """SELECT doc_id, line, CASE line % 4 WHEN 0 THEN ' **Title:** ' || t WHEN 1 THEN '# ' || t
   WHEN 2 THEN '  ##  ' || t ELSE t END AS x FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line
     FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""), body="SELECT doc_id, line, md5(" +
    f"CASE WHEN {{t}} = '' OR length({{t}}) > 60 THEN 'Report' ELSE {{t}} END".replace("{t}",
    S.trim("trim(" + S.trim("regexp_replace(trim(" + S.trim("x") + ", '#*- '), '^(?i:title:)', '')") + ", '*#: ')")) + ") AS result FROM d"))
def report_title(spark, d):
    """Every line of every document as the first line of a report."""
    rows = V.documents(spark, d).select("doc_id", F.posexplode(F.split(TEXT, "\n", -1)).alias("i", "t"))
    rows = rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), "t")
    n = F.col("line") % 4
    src = F.when(n == 0, F.concat(L(" **Title:** "), "t")).when(n == 1, F.concat(L("# "), "t")).when(
        n == 2, F.concat(L("  ##  "), "t")).otherwise(F.col("t"))
    return rows.withColumn("_in", src).select("doc_id", "line", F.md5(T.report_title("_in", L("Report"))).alias("result"))


NL = "chr(10)"


@query("split_title_body", S.with_views(("d", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN chr(10) || ' ' || chr(10) || '# - ' || text ELSE text END AS x FROM documents"),
    ("e", f"SELECT doc_id, x, string_split(x, {NL}) AS ls, list_position(list_transform(string_split(x, {NL}), lambda l: {S.trim('l')} <> ''), true) AS p FROM d"),
    ("f", f"SELECT *, {S.trim('ltrim(ls[p], {q}#-* {q})'.format(q=chr(39)))} AS t, {S.trim(f'array_to_string(ls[p + 1:], {NL})')} AS b FROM e"), body=f"""
    SELECT doc_id, CASE WHEN t = '' OR t IS NULL THEN 'Untitled' ELSE left(t, 60) END AS title,
    md5(CASE WHEN b = '' OR b IS NULL THEN {S.trim('x')} ELSE b END) AS body FROM f"""))
def split_title_body(spark, d):
    docs = V.documents(spark, d).withColumn("_in", pick(4, F.concat(L("\n \n# - "), TEXT), TEXT))
    return docs.withColumn("p", T.split_title_body("_in", L("Untitled"))).select(
        "doc_id", "p.title", F.md5("p.body").alias("body"))


def raw_answer(text):
    return pick(5, F.concat(L("<think>a</think> <answer> "), text, L(" </answer> rest")),
                F.concat(L("<think>x<answer>y</think>"), text), F.concat(text, L("<think>never ends")),
                F.concat(L("<answer>"), text), text)


RAW_SQL = """CASE doc_id % 5 WHEN 0 THEN '<think>a</think> <answer> ' || text || ' </answer> rest'
   WHEN 1 THEN '<think>x<answer>y</think>' || text WHEN 2 THEN text || '<think>never ends' WHEN 3 THEN '<answer>' || text ELSE text END"""


@query("extract_answer", S.with_views(body=f"SELECT doc_id, md5({S.trim('text')}) AS result FROM documents")[6:])
def extract_answer(spark, d):
    return doc_md5(spark, d, raw_answer(TEXT), T.extract_answer)


OPEN_RX = "|".join(w.replace(",", ",?") for w in rules.OPENERS)


@query("strip_openers", doc_sql("CASE doc_id % 4 WHEN 0 THEN ' hi, ' || text WHEN 1 THEN 'And  ' || text WHEN 2 THEN 'btw ' || text ELSE text END",
       f"regexp_replace({S.trim('x')}, '^(?i:(?:{OPEN_RX}) )\\s*', '')"))
def strip_openers(spark, d):
    return doc_md5(spark, d, pick(4, F.concat(L(" hi, "), TEXT), F.concat(L("And  "), TEXT), F.concat(L("btw "), TEXT), TEXT),
                   T.strip_openers)


CUT = S.trim("rtrim(" + S.trim(f"regexp_replace(x, '(?is)(?:{'|'.join(rules.COMMAND_TAILS)}).*$', '')") + ", ',.—-')")


@query("strip_trailing_command", doc_sql("""text || CASE doc_id % 4 WHEN 0 THEN ', find him now' WHEN 1 THEN ' and then look her up' WHEN 2 THEN ', please.' ELSE '' END""",
   f"regexp_replace({CUT}, '(?i)(?:^|(?:\\s|[,.])*\\s)(?:(?:{'|'.join(rules.DANGLING_WORDS)})[,.]*(?:\\s+|$))+$', '')"))
def strip_trailing_command(spark, d):
    return doc_md5(spark, d, pick(4, F.concat(TEXT, L(", find him now")), F.concat(TEXT, L(" and then look her up")),
                                  F.concat(TEXT, L(", please.")), TEXT), T.strip_trailing_command)


HEAD_HASH = "('0x' || substr(md5(left(text, 80)), 1, 8))::BIGINT"


@query("truncate_chars", "SELECT source, " + ", ".join(f"sum(length(left(text, {n})))::BIGINT AS c{n}" for n in (80, 200, 500, 2500))
       + f", sum({HEAD_HASH})::BIGINT AS heads FROM documents GROUP BY source")
def truncate_chars(spark, d):
    docs = V.documents(spark, d)
    heads = docs.select("source", *[T.truncate_chars("text", n).alias(f"_{n}") for n in (80, 200, 500, 2500)])
    digest = F.conv(F.substring(F.md5("_80"), 1, 8), 16, 10).cast("long")
    return heads.groupBy("source").agg(*[F.sum(F.length(f"_{n}").cast("long")).alias(f"c{n}") for n in (80, 200, 500, 2500)],
                                       F.sum(digest).alias("heads"))


# --- time -------------------------------------------------------------------------

@query("fmt_ts", f"SELECT event_id, {S.fmt_ts('ts')} AS full_text, strftime(ts + INTERVAL 5 HOUR, '%H:%M') AS clock FROM events")
def fmt_ts(spark, d):
    return V.table(spark, d, "events").select("event_id", C.fmt_ts("ts").alias("full_text"),
                                              C.fmt_hm("ts", "Asia/Karachi").alias("clock"))


@query("rel_age", S.with_views("clock", body=f"SELECT age, count(*) AS n FROM (SELECT {S.rel_age('ts', 'as_of')} AS age FROM events, clock) GROUP BY age"))
def rel_age(spark, d):
    return V.table(spark, d, "events").groupBy(C.rel_age("ts", as_of(spark, d)).alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query("when_word", S.with_views("clock", body="""SELECT CASE WHEN s < 86400 THEN 'Today' WHEN s < 172800 THEN 'Yesterday' ELSE 'Recently' END AS word,
   count(*) AS n FROM (SELECT (epoch_us(as_of) - epoch_us(ts)) // 1000000 AS s FROM events, clock) GROUP BY ALL"""))
def when_word(spark, d):
    return V.table(spark, d, "events").groupBy(C.when_word("ts", as_of(spark, d)).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("hour_bucket", "SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY ALL")
def hour_bucket(spark, d):
    return V.table(spark, d, "events").groupBy(C.hour_bucket("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("week_bucket", "SELECT epoch_us(ts) // 604800000000 AS week, count(*) AS n FROM events GROUP BY ALL")
def week_bucket(spark, d):
    return V.table(spark, d, "events").groupBy(C.week_bucket("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("local_midnight_cutoff", """SELECT date_trunc('day', ts + INTERVAL 5 HOUR) - INTERVAL 5 HOUR - INTERVAL 6 DAY AS cutoff,
   count(*) AS n FROM events GROUP BY ALL""")
def local_midnight_cutoff(spark, d):
    return V.table(spark, d, "events").groupBy(
        C.local_midnight_cutoff(F.col("ts"), 7, "Asia/Karachi").alias("cutoff")).agg(F.count(F.lit(1)).alias("n"))


# --- numbers ----------------------------------------------------------------------

def numeric_docs(spark, d):
    return V.documents(spark, d).withColumn("text", F.concat(
        "text", L(" paid 1,000.50 at 09:30 from 10.0.0.5, item "), F.col("n_chars").cast("string"), L(".")))


NUMERIC = ("nd", "SELECT *, text || ' paid 1,000.50 at 09:30 from 10.0.0.5, item ' || n_chars || '.' AS t FROM documents")


@query("number_tokens", S.with_views(NUMERIC, body="""SELECT source, tok, count(*) AS n FROM (SELECT source,
   unnest(regexp_extract_all(t, '[0-9][0-9.,:]*[0-9]|[0-9]')) AS tok FROM nd) GROUP BY ALL"""))
def number_tokens(spark, d):
    t = numeric_docs(spark, d).select("source", F.explode(N.number_tokens("text")).alias("tok"))
    return t.groupBy("source", "tok").agg(F.count(F.lit(1)).alias("n"))


@query("num_key", S.with_views(NUMERIC, body="""SELECT k, count(*) AS n FROM (SELECT CASE WHEN TRY_CAST(replace(tok, ',', '') AS DOUBLE) >= 1e12 THEN 'big'
   WHEN TRY_CAST(replace(tok, ',', '') AS DOUBLE) IS NOT NULL
   THEN 'v' || round(TRY_CAST(replace(tok, ',', '') AS DOUBLE) * 100)::HUGEINT
   ELSE 'c' || coalesce(nullif(ltrim(regexp_replace(tok, '[^0-9]', '', 'g'), '0'), ''), '0') END AS k
   FROM (SELECT unnest(regexp_extract_all(t, '[0-9][0-9.,:]*[0-9]|[0-9]')) AS tok FROM nd)) GROUP BY ALL"""))
def num_key(spark, d):
    t = numeric_docs(spark, d).select(F.explode(N.number_tokens("text")).alias("tok"))
    v = N.num_value(F.col("tok"))
    key = F.when(v >= 1e12, L("big")).when(v.isNotNull(), F.concat(L("v"), F.round(v * 100).cast("decimal(38,0)").cast("string"))).otherwise(
        F.concat(L("c"), N.num_core(F.col("tok"))))
    return t.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- payloads ---------------------------------------------------------------------

ODD = "seq % 97"


@query("json_text", S.with_views("l0t", body=f"SELECT id, CASE WHEN {ODD} IN (1, 2, 3) THEN 'RAW' ELSE md5(text) END AS result FROM l0t"))
def json_text(spark, d):
    p = V.payloads(spark, d)
    t = J.json_text("data_json")
    return p.select("id", F.when(t == F.col("data_json"), L("RAW")).otherwise(F.md5(t)).alias("result"))


@query("json_app_title", S.with_views("l0t", body=f"""SELECT CASE WHEN {ODD} IN (1, 2, 3) THEN '' ELSE app_name END AS app,
   CASE WHEN {ODD} IN (1, 2, 3) THEN '' ELSE window_title END AS title, count(*) AS n FROM l0t GROUP BY ALL"""))
def json_app_title(spark, d):
    return V.payloads(spark, d).groupBy(J.json_app("data_json").alias("app"), J.json_title("data_json").alias("title")) \
        .agg(F.count(F.lit(1)).alias("n"))


PREVIEW = f"""CASE {ODD} WHEN 1 THEN '{{"app_name":5,"window_title":true,"text":12}}'
   WHEN 2 THEN '{{"app_name":"x","text":' || id ELSE left(text, 200) END"""


@query("text_preview", S.with_views("l0t", body=f"SELECT id, {PREVIEW} AS preview FROM l0t"))
def text_preview(spark, d):
    return V.payloads(spark, d).select("id", J.text_preview("data_json").alias("preview"))


@query("is_screen_event", S.with_views("l0", body=f"""SELECT stream, count(*) AS n, count(*) FILTER ({ODD} NOT IN (1, 2, 3)
   AND app_name NOT IN ('clipboard', 'system', 'user')) AS screen FROM l0 GROUP BY stream"""))
def is_screen_event(spark, d):
    return V.payloads(spark, d).groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(J.is_screen_event("data_json")).alias("screen"))


@query("is_qa_event", S.with_views("l0", body=f"""SELECT stream, count(*) FILTER ({ODD} NOT IN (1, 2, 3)
   AND app_name = 'dialogue') AS qa FROM l0 GROUP BY stream"""))
def is_qa_event(spark, d):
    return V.payloads(spark, d).groupBy("stream").agg(F.count_if(J.is_qa_event("data_json")).alias("qa"))


@query("parse_qa", S.with_views("qa", body=f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'none' ELSE md5({S.trim('question')}) END AS q,
   CASE WHEN turn % 4 = 2 THEN 'none' ELSE md5({S.trim('answer')}) END AS a FROM qa"""))
def parse_qa(spark, d):
    stored = F.when(F.col("turn") % 4 == 2, F.concat(L("A: "), "answer")).otherwise(
        F.concat(L("Q:  "), "question", L(" \nA: "), "answer", L(" ")))
    p = V.qa_pairs(spark, d).withColumn("p", J.parse_qa(stored))
    return p.select("conv_id", "turn", F.coalesce(F.md5("p.question"), L("none")).alias("q"),
                    F.coalesce(F.md5("p.answer"), L("none")).alias("a"))


@query("sub_event_map", S.with_views("l0t", body="""SELECT app_name AS act, count(*) AS n,
   count(*) FILTER (text <> '' AND app_name <> 'clipboard') AS with_ocr,
   count(*) FILTER (text <> '' AND app_name = 'clipboard') AS with_clip FROM l0t GROUP BY ALL"""))
def sub_event_map(spark, d):
    m = V.memory(spark, d, text=True).withColumn("e", J.sub_event(C.micros("time_start"), "app_name", "text"))
    return m.groupBy("e.act").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("e.ocr_full") != "").alias("with_ocr"),
                                  F.count_if(F.col("e.clipboard") != "").alias("with_clip"))


@query("memory_projection", S.with_views("l0t", body=f"""SELECT 0 AS level, count(*) AS n, count(*) FILTER ({ODD} = 2) AS malformed,
   count(*) FILTER ({ODD} NOT IN (1, 2, 3) AND app_name NOT IN ('clipboard', 'system', 'user')) AS screen,
   count(*) FILTER ({ODD} NOT IN (1, 2, 3) AND app_name = 'dialogue') AS qa,
   sum(length({PREVIEW}))::BIGINT AS preview_chars FROM l0t"""))
def memory_projection(spark, d):
    return Q.projection_report(Q.memory_projection(V.payloads(spark, d)))


# --- corpora ----------------------------------------------------------------------

CLEAN_SQL = "replace(replace(replace(array_to_string(list_filter(string_split({x}, chr(10)), lambda l: NOT starts_with(ltrim(l), '##')), chr(10)), 'SCREEN ', ''), '(level 1+)', ''), 'level 1+', '')"


@query("clean_corpus", S.with_views(("a", f"SELECT source, lang, text, array_to_string({LINES.replace('string_split(x', 'string_split(text')}, chr(10)) AS x FROM documents"),
    ("b", f"SELECT *, {NOISE_SQL} AS y FROM a"), ("c", f"SELECT *, {CLEAN_SQL.format(x='y')} AS z FROM b"), body=f"""
    SELECT source, lang, count(*) AS docs, sum(length(text) - length(z))::BIGINT AS chars_removed,
    count(*) FILTER ({S.trim('z')} = '') AS emptied FROM c GROUP BY ALL"""))
def clean_corpus(spark, d):
    return Q.clean_corpus(V.documents(spark, d))


TAG_LIST = "list_filter([" + ", ".join(S.case([(S.has_any("t", tw) + " OR " + S.has_any("a", aw), S.lit(tag))])
                                       for tag, tw, aw in rules.TAG_RULES) + "], lambda x: x IS NOT NULL)"
TAGGED = ("tagged", f"SELECT doc_id, source, {TAG_LIST} AS tags FROM (SELECT doc_id, source, lower(text) AS t, lower(source) AS a FROM documents)")


def tagged_docs(spark, d):
    return V.documents(spark, d).select("doc_id", "source", K.auto_tag("text", "source", "source").alias("tags"))


@query("auto_tag", S.with_views(TAGGED, body="SELECT doc_id, array_to_string(tags, ' ') AS tags FROM tagged"))
def auto_tag(spark, d):
    return tagged_docs(spark, d).select("doc_id", F.array_join("tags", " ").alias("tags"))


MEMORY_TAGS = "list_filter([" + ", ".join(S.case([(S.has_any("t", tw) + " OR " + S.has_any("a", aw) + " OR " + S.has_any("w", aw), S.lit(tag))])
                                          for tag, tw, aw in rules.TAG_RULES) + "], lambda x: x IS NOT NULL)"


@query("tag_corpus", S.with_views("l0t", ("t", f"""SELECT id, app_name, unnest({MEMORY_TAGS}) AS tag FROM (
   SELECT id, app_name, lower(text) AS t, lower(app_name) AS a, lower(window_title) AS w FROM l0t)"""), body="""
   SELECT a.app_name, a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM t a JOIN t b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL"""))
def tag_corpus(spark, d):
    m = V.memory(spark, d, text=True)
    return Q.tag_pairs(m.select("app_name", K.auto_tag("text", "app_name", "window_title").alias("tags")), ["app_name"])


@query("activity_mix", S.with_views("l0", ACTIVITY, *PHRASES, body="""SELECT category, stream, epoch_us(time_start) // 3600000000 AS hour,
   count(*) AS n FROM phrases GROUP BY ROLLUP (category, stream, epoch_us(time_start) // 3600000000)"""))
def activity_mix(spark, d):
    return Q.activity_mix(W.with_phrases(W.activity_feed(V.memory(spark, d))))


# --- questions --------------------------------------------------------------------

Q_LOW = "lower(text)"
BARE = S.trim("regexp_replace(lower(text), '[^\\p{L}\\p{N} ]', '', 'g')")


def flags(name, cond, fn):
    """A yes/no rule over all questions, counted per question text."""
    sql = S.with_views("asks", body=f"SELECT text, {cond} AS flag, count(*) AS n FROM asks GROUP BY ALL")

    @query(name, sql)
    def run(spark, d):
        return V.asks(spark, d).groupBy("text", fn("text").alias("flag")).agg(F.count(F.lit(1)).alias("n"))
    return run


RECALL_SQL = S.has_any(Q_LOW, rules.RECALL_PHRASES)
SELF_SQL = f"regexp_matches({Q_LOW}, '(^|[^\\p{{L}}\\p{{N}}])(i|im|me|my|mine)([^\\p{{L}}\\p{{N}}]|$)')"
SCREEN_SQL = (f"({RECALL_SQL} OR {S.has_any(Q_LOW, rules.SCREEN_PHRASES)} OR ({S.has_any(Q_LOW, rules.SCREEN_ACTIVITY_WORDS)}"
              f" AND ({SELF_SQL} OR {S.has_any(Q_LOW, rules.SCREEN_OPEN_CUES)})))")
WEB_SQL = (f"CASE WHEN {S.has_any(Q_LOW, rules.WEB_REFUSED)} OR {S.has_any(Q_LOW, rules.WEB_LOCAL_ONLY)} THEN false "
           f"ELSE {S.has_any(Q_LOW, rules.WEB_WANTED)} END")
NAME_SQL = f"({S.isin(BARE, rules.NAME_QUESTIONS_EXACT)} OR {S.has_any(Q_LOW, rules.NAME_QUESTIONS)})"
IDENT_SQL = f"({S.isin(BARE, rules.IDENTITY_QUESTIONS_EXACT)} OR {S.has_any(Q_LOW, rules.IDENTITY_QUESTIONS)})"
SECRET_SQL = f"({S.has_any(Q_LOW, rules.SECRET_WORDS)} AND {S.has_any(Q_LOW, rules.SECRET_ABOUT_STORE)})"

flags("needs_web", WEB_SQL, K.needs_web)
flags("activity_recall", RECALL_SQL, K.is_activity_recall)
flags("screen_query", SCREEN_SQL, K.is_screen_query)
flags("secret_question", SECRET_SQL, K.asks_about_secrets)


@query("identity_questions", S.with_views("asks", body=f"SELECT text, {NAME_SQL} AS name, {IDENT_SQL} AS assistant, count(*) AS n FROM asks GROUP BY ALL"))
def identity_questions(spark, d):
    return V.asks(spark, d).groupBy("text", K.asks_user_name("text").alias("name"), K.asks_identity("text").alias("assistant")) \
        .agg(F.count(F.lit(1)).alias("n"))


REPORT_SQL = (f"CASE WHEN {S.has_any(Q_LOW, rules.REPORT_VERBS)} THEN CASE WHEN contains({Q_LOW}, 'week') THEN 7 "
              f"WHEN contains({Q_LOW}, 'month') THEN 30 ELSE 1 END ELSE 0 END")


@query("report_request", S.with_views("asks", body=f"SELECT {REPORT_SQL} AS days, count(*) AS n FROM asks GROUP BY ALL"))
def report_request(spark, d):
    return V.asks(spark, d).groupBy(F.coalesce(K.report_days("text"), F.lit(0)).alias("days")).agg(F.count(F.lit(1)).alias("n"))


def rx(words):
    return "|".join(w.replace(".", "\\.") for w in words).replace("'", "''")


OPEN_SQL = f"regexp_replace({S.trim('text')}, '^(?i:(?:{OPEN_RX}) )\\s*', '')"
ENT1 = ("ent1", f"""SELECT *, rtrim(regexp_extract(q, '(?is)^.*?(?:{rx(rules.PERSON_LEADS)})(.*)$', 1), '?!.') AS pr,
   {S.trim(f"regexp_replace(regexp_replace({S.trim(f'''rtrim(regexp_extract(q, '(?is)^.*?(?:{rx(rules.ABOUT_LEADS)})(.*)$', 1), '?!.')''')}, '^(the )+', ''), '^(a )+', '')")} AS ab
   FROM (SELECT *, {OPEN_SQL} AS q FROM asks)""")


def first_word(x):
    return S.trim_alnum(f"lower(({S.words(x)})[1])")


ENT2 = ("ent2", f"""SELECT *, CASE WHEN len({S.words('pr')}) > 0 AND NOT ({S.isin(first_word('pr'), rules.PERSON_STOP_FIRST)}) THEN {S.trim('pr')} END AS person,
   CASE WHEN len({S.words('ab')}) BETWEEN 1 AND 6 AND length(ab) <= 60 AND NOT ({S.isin(first_word('ab'), rules.ABOUT_STOP_FIRST)}) THEN ab END AS about
   FROM ent1""")
NAMES = f"""list_filter(list_transform(({S.words('q')})[2:], lambda w: regexp_replace(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}-]+', ''), '[^\\p{{L}}\\p{{N}}-]+$', '')),
   lambda w: regexp_matches(w, '^\\p{{Lu}}') AND regexp_matches(w, '\\p{{Ll}}') AND length(w) >= 3)"""
ENT = ("ent", f"""SELECT conv_id, turn, of_turn, ts, text, person, about, coalesce(person, about) AS subject, coalesce(person, about,
   CASE WHEN {S.starts('lower(q)', rules.FACT_LEADS)} AND len({NAMES}) > 0 THEN array_to_string({NAMES}, ' ') END) AS named FROM ent2""")
ENTITY = ["asks", ENT1, ENT2, ENT]


@query("person_in_question", S.with_views(*ENTITY, body="SELECT conv_id, turn, coalesce(person, '-') AS person FROM ent"))
def person_in_question(spark, d):
    return V.asks(spark, d).select("conv_id", "turn", F.coalesce(K.person_in_question("text"), L("-")).alias("person"))


@query("about_subject", S.with_views(*ENTITY, body="SELECT conv_id, turn, coalesce(about, '-') AS about FROM ent"))
def about_subject(spark, d):
    return V.asks(spark, d).select("conv_id", "turn", F.coalesce(K.about_subject("text"), L("-")).alias("about"))


@query("named_entity", S.with_views(*ENTITY, body="SELECT conv_id, turn, coalesce(named, '-') AS named FROM ent"))
def named_entity(spark, d):
    return V.asks(spark, d).select("conv_id", "turn", F.coalesce(K.named_entity("text"), L("-")).alias("named"))


# Statements among the derived questions come in three shapes.
STMT = ("stmt", """SELECT *, CASE WHEN starts_with(text, 'no his nickname is ') THEN 'rename'
     WHEN starts_with(text, 'he is a ') OR starts_with(text, 'i mean the ') THEN 'fact' END AS kind,
   CASE WHEN starts_with(text, 'no his nickname is ') THEN substring(text, 20)
     WHEN starts_with(text, 'he is a ') THEN replace(substring(text, 9), ', find him', '')
     WHEN starts_with(text, 'i mean the ') THEN replace(substring(text, 12), ' one and', ' one') END AS value FROM ent""")


@query("entity_statement", S.with_views(*ENTITY, STMT, body="SELECT conv_id, turn, coalesce(kind, '-') AS kind, coalesce(value, '-') AS value FROM stmt"))
def entity_statement(spark, d):
    s = V.asks(spark, d).withColumn("s", K.entity_statement("text"))
    return s.select("conv_id", "turn", F.coalesce("s.kind", L("-")).alias("kind"), F.coalesce("s.value", L("-")).alias("value"))


REF_SQL = f"list_bool_or(list_transform({S.words(Q_LOW)}, lambda w: {S.isin(S.trim_alnum('w'), rules.REFERENCE_WORDS)}))"
ROUTED = ("routed", f"""SELECT *, {S.case([("kind IS NOT NULL AND entity", "'taught'"), (f"{REPORT_SQL} > 0", "'report'"), (SECRET_SQL, "'secrets'"),
    (RECALL_SQL, "'recall'"), (IDENT_SQL, "'identity'"), (NAME_SQL, "'name'")], "'model'")} AS route,
   prev IS NOT NULL AND {REF_SQL} AS followup FROM (SELECT *, count(subject) OVER (PARTITION BY conv_id ORDER BY turn
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS entity, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM stmt)""")
ROUTING = [*ENTITY, STMT, ROUTED]


@query("query_route", S.with_views(*ROUTING, body="SELECT conv_id, turn, route FROM routed"))
def query_route(spark, d):
    return Q.routed(V.asks(spark, d)).select("conv_id", "turn", "route")


@query("followup_flag", S.with_views(*ROUTING, body="SELECT conv_id, turn, followup FROM routed"))
def followup_flag(spark, d):
    return Q.routed(V.asks(spark, d)).select("conv_id", "turn", "followup")


@query("query_mix", S.with_views(*ROUTING, body="""SELECT day, route, followup, n, round(n / sum(n) OVER (PARTITION BY day), 6)::DOUBLE AS share
   FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, route, followup, count(*) AS n FROM routed GROUP BY ALL)"""))
def query_mix(spark, d):
    return Q.query_mix(Q.routed(V.asks(spark, d)))


@query("subject_index", S.with_views(*ENTITY, ("subj", "SELECT named AS subject, count(*) AS asked, min(ts) AS first_ts, max(ts) AS last_ts FROM ent WHERE named IS NOT NULL GROUP BY 1"),
    ("stok", f"SELECT DISTINCT subject, word FROM (SELECT subject, lower({S.trim_alnum('w')}) AS word FROM (SELECT subject, unnest({S.words('subject')}) AS w FROM subj)) WHERE length(word) >= 3"),
    ("dtok", f"SELECT DISTINCT doc_id, lower({S.trim_alnum('w')}) AS word FROM (SELECT doc_id, unnest({S.words('text')}) AS w FROM documents)"), body="""
   SELECT s.*, coalesce(h.docs, 0) AS docs FROM subj s LEFT JOIN (SELECT subject, count(DISTINCT doc_id) AS docs
     FROM stok JOIN dtok USING (word) GROUP BY subject) h USING (subject)"""))
def subject_index(spark, d):
    return Q.subject_index(V.asks(spark, d), V.documents(spark, d).select("doc_id", "text"))


@query("entity_grounded", S.with_views(*ENTITY, "qa", ("t", f"""SELECT e.conv_id, e.turn, list_bool_or(list_transform(list_filter(list_transform(
   {S.words('named')}, lambda w: lower({S.trim_alnum('w')})), lambda w: length(w) >= 3), lambda w: contains(lower(q.question || ' ' || q.answer), w))) AS g
   FROM ent e JOIN qa q ON q.conv_id = e.conv_id AND q.turn = e.of_turn WHERE named IS NOT NULL"""), body="SELECT conv_id, turn, coalesce(g, false) AS grounded FROM t"))
def entity_grounded(spark, d):
    qa = V.qa_pairs(spark, d).select("conv_id", F.col("turn").alias("of_turn"), F.concat("question", L(" "), "answer").alias("facts"))
    named = V.asks(spark, d).withColumn("named", K.named_entity("text")).filter(F.col("named").isNotNull())
    return named.join(qa, ["conv_id", "of_turn"]).select("conv_id", "turn", K.entity_grounded("named", "facts").alias("grounded"))


@query("unanswerable_followup", S.with_views("asks", body=f"""SELECT conv_id, turn, (turn % 4 = 0 OR conv_id % 2 = 0) AND
   (ends_with({Q_LOW}, '?') OR {S.starts(Q_LOW, rules.FOLLOWUP_STARTS)}) AND {S.has_any(Q_LOW, rules.THIRD_PERSON_CUES)} AND conv_id % 3 <> 0 AS flag FROM asks"""))
def unanswerable_followup(spark, d):
    a = V.asks(spark, d)
    web = F.when(F.col("conv_id") % 2 == 0, L("  ")).otherwise(L("found"))
    return a.select("conv_id", "turn", K.unanswerable_followup(
        "text", F.col("conv_id") % 3 != 0, F.col("turn") % 4 == 0, web).alias("flag"))


GAME_NAMES = rules.GAME_EXES[:2]
GAME = f"""SELECT doc_id, CASE i % 5 WHEN 0 THEN 'C:\\Games\\' || w || '.EXE' WHEN 1 THEN '/usr/bin/' || w WHEN 2 THEN 'c:\\EAC\\' || w
   WHEN 3 THEN '/games/' || w || '/{GAME_NAMES[0]}.bin' ELSE 'd:\\' || w || '\\{GAME_NAMES[1]}' END AS path, i % 5 IN (2, 3, 4) AS shaped
   FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM (
     SELECT doc_id, list_filter(regexp_split_to_array(text, '[ {chr(10)}]+'), lambda w: w <> '') AS ws FROM documents))"""


@query("game_path", S.with_views(("g", GAME), body=f"""SELECT doc_id, count(*) AS paths, count(*) FILTER (WHERE shaped OR {S.has_any('lower(path)', rules.ANTICHEAT_HINTS)}
   OR {S.isin("regexp_replace(regexp_extract(lower(path), '([^/{chr(92)}{chr(92)}]*)$', 1), '(.)[.][^.]*$', '{chr(92)}1')", rules.GAME_EXES)}) AS games FROM g GROUP BY doc_id"""))
def game_path(spark, d):
    """Every word of every document as a part of a path."""
    words = F.filter(F.split(TEXT, "[ \n]+"), lambda w: w != "")
    e = V.documents(spark, d).select("doc_id", F.posexplode(words).alias("i", "w"))
    k = F.col("i") % 5
    path = (F.when(k == 0, F.concat(L("C:\\Games\\"), "w", L(".EXE"))).when(k == 1, F.concat(L("/usr/bin/"), "w"))
            .when(k == 2, F.concat(L("c:\\EAC\\"), "w")).when(k == 3, F.concat(L("/games/"), "w", L(f"/{GAME_NAMES[0]}.bin")))
            .otherwise(F.concat(L("d:\\"), "w", L(f"\\{GAME_NAMES[1]}"))))
    return e.withColumn("path", path).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paths"), F.count_if(K.is_game_path("path")).alias("games"))


@query("code_editor", S.with_views("l0", body=f"SELECT app_name, {S.has_any('lower(app_name)', rules.TIGHT_HASH_APPS)} AS editor, count(*) AS n FROM l0 GROUP BY ALL"))
def code_editor(spark, d):
    return V.memory(spark, d).groupBy("app_name", K.is_code_editor("app_name").alias("editor")).agg(F.count(F.lit(1)).alias("n"))


# --- back references and entities ---------------------------------------------------

PREV = ("prevq", "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM asks")
P_SQL = f"rtrim({S.trim('prev')}, '?!.,')"
LEAD_RX = f"(?is)^(?:{rx(rules.REFERENT_LEADS)})"
CAPS = ("caps", f"""SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS run, count(*) AS n, min(i) AS start FROM (
   SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, cap ORDER BY i) AS g FROM (
     SELECT conv_id, turn, w, i, regexp_matches(w, '^\\p{{Lu}}') AS cap FROM (
       SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn,
         list_filter(list_transform({S.words(P_SQL)}, lambda w: {S.trim_alnum('w')}), lambda w: w <> '') AS ws FROM prevq WHERE prev IS NOT NULL))))
   WHERE cap GROUP BY conv_id, turn, g QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, min(i) DESC) = 1""")
TAIL_RX = "(?i)(?:(?:^| )(?:" + "|".join(rules.CONNECTORS + rules.REFERENT_TAIL_WORDS) + "))+$"
REFERENT = ("referent", f"""SELECT conv_id, turn, text, CASE WHEN length(c) BETWEEN 2 AND 60 AND len(string_split(c, ' ')) <= 6
     AND NOT ({S.isin('lower(c)', rules.PRONOUNS)}) AND NOT ({S.isin(S.trim_alnum("lower(string_split(c, ' ')[1])"), rules.NON_ENTITY_FIRST)}) THEN c END AS ref
   FROM (SELECT conv_id, turn, text, regexp_replace(array_to_string({S.words("trim(cand, chr(34) || chr(39) || '«»')")}, ' '), '{TAIL_RX}', '') AS c FROM (
     SELECT p.conv_id, p.turn, p.text, coalesce(CASE WHEN regexp_matches({P_SQL}, '{LEAD_RX}') THEN {S.trim(f"regexp_replace({P_SQL}, '{LEAD_RX}', '')")} END,
       CASE WHEN contains(lower({P_SQL}), ' about ') THEN {S.trim(f"regexp_extract({P_SQL}, '(?is)^.* about (.*)$', 1)")} END,
       CASE WHEN NOT (c.n = 1 AND c.start = 1) THEN c.run END) AS cand FROM prevq p LEFT JOIN caps c USING (conv_id, turn)))""")
RESOLVED = ("resolved", """SELECT *, CASE WHEN ref IS NULL THEN NULL WHEN text = 'open video about him' THEN 'open video about ' || ref
   WHEN text = 'play her' THEN 'play ' || ref WHEN starts_with(text, 'search his ') THEN 'search ' || ref || substring(text, 11) END AS resolved FROM referent""")


@query("referent_of", S.with_views("asks", PREV, CAPS, REFERENT, body="SELECT conv_id, turn, coalesce(ref, '-') AS referent FROM referent"))
def referent_of(spark, d):
    r = W.backreference_resolve(V.asks(spark, d))
    return r.select("conv_id", "turn", F.coalesce("referent", L("-")).alias("referent"))


@query("backreference_resolve", S.with_views("asks", PREV, CAPS, REFERENT, RESOLVED, body="SELECT conv_id, turn, coalesce(resolved, '-') AS resolved FROM resolved"))
def backreference_resolve(spark, d):
    r = W.backreference_resolve(V.asks(spark, d))
    return r.select("conv_id", "turn", F.coalesce("resolved", L("-")).alias("resolved"))


@query("entity_tracking", S.with_views(*ENTITY, STMT, ("steps", "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM stmt"), body="""
   , walk AS (
     SELECT conv_id, n, subject AS name, CASE WHEN subject IS NOT NULL THEN turn END AS episode, []::VARCHAR[] AS facts FROM steps WHERE n = 1
     UNION ALL
     SELECT conv_id, n, CASE WHEN opens THEN subject ELSE name END, CASE WHEN opens THEN turn ELSE episode END,
       CASE WHEN opens THEN []::VARCHAR[] ELSE facts END FROM (
       SELECT *, subject IS NOT NULL AND (name IS NULL OR lower(name) <> lower(subject)) AS opens FROM (
         SELECT s.conv_id, s.n, s.subject, s.turn, w.episode,
           CASE WHEN w.name IS NOT NULL AND s.kind = 'rename' THEN s.value ELSE w.name END AS name,
           CASE WHEN w.name IS NOT NULL AND s.kind = 'fact' AND NOT list_contains(list_transform(w.facts, lambda f: lower(f)), lower(s.value))
             THEN list_append(w.facts, s.value)[-3:] ELSE w.facts END AS facts
         FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.n = w.n + 1)))
   SELECT conv_id, episode, name, array_to_string(facts, '; ') AS facts,
     CASE WHEN len(facts) = 0 THEN name ELSE name || ' ' || array_to_string(facts, ' ') END AS search_term
   FROM walk WHERE episode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, episode ORDER BY n DESC) = 1""").replace("WITH ", "WITH RECURSIVE ", 1))
def entity_tracking(spark, d):
    return W.entity_tracking(V.asks(spark, d))


# --- audits -------------------------------------------------------------------------

def audited(spark, d):
    """Stored answers with a stated figure and date; every third fact lacks them."""
    qa = V.qa_pairs(spark, d)
    n = (F.col("conv_id") * 37 + F.col("turn")).cast("string")
    raw = F.concat(L("<think>7</think><answer>"), "answer", L(" It cost $"), n, L(".00 on June 5, about 3 of 1,200 at 9:30."), L("</answer>"))
    facts = F.when(F.col("conv_id") % 3 == 0, F.concat("question", L(" nothing"))).otherwise(
        F.concat("question", L(" cost "), n, L(" June 05 1200 logged 09:30 v 5.0")))
    return qa.select("ts", "conv_id", "turn", raw.alias("raw"), facts.alias("facts"))


NUMS = "regexp_extract_all({x}, '[0-9][0-9.,:]*[0-9]|[0-9]')"
VAL = "TRY_CAST(replace({t}, ',', '') AS DOUBLE)"
CORE = "coalesce(nullif(ltrim(regexp_replace({t}, '[^0-9]', '', 'g'), '0'), ''), '0')"
MONTHS = "|".join(rules.MONTHS)
MCODE = S.case([(f"lower({{m}}) = '{k}'", f"'{v}'") for k, v in rules.MONTHS.items()])
AUDITED = ("audited", """SELECT ts, conv_id, turn, answer || ' It cost $' || (conv_id * 37 + turn) || '.00 on June 5, about 3 of 1,200 at 9:30.' AS a,
   CASE WHEN conv_id % 3 = 0 THEN question || ' nothing' ELSE question || ' cost ' || (conv_id * 37 + turn) || ' June 05 1200 logged 09:30 v 5.0' END AS f FROM qa""")
BAD = ("bad", f"""SELECT ts, conv_id, turn, {S.trim('a')} AS a, len(list_filter({NUMS.format(x='a')}, lambda t: CASE WHEN {VAL.format(t='t')} IS NOT NULL
     THEN NOT (floor({VAL.format(t='t')}) = {VAL.format(t='t')} AND abs({VAL.format(t='t')}) < 10)
       AND NOT coalesce(list_bool_or(list_transform({NUMS.format(x='f')}, lambda u: abs({VAL.format(t='u')} - {VAL.format(t='t')}) < 1e-6)), false)
     ELSE length(regexp_replace(t, '[^0-9]', '', 'g')) >= 2 AND NOT list_contains(list_transform(list_filter({NUMS.format(x='f')},
       lambda u: {VAL.format(t='u')} IS NULL), lambda u: {CORE.format(t='u')}), {CORE.format(t='t')}) END)) AS nums,
   len(list_filter(list_transform(regexp_extract_all(a, '(?i)\\b[0-9]{{1,2}}\\s+(?:{MONTHS})\\b|\\b(?:{MONTHS})\\.?\\s+[0-9]{{1,4}}\\b'),
     lambda h: {MCODE.format(m=f"regexp_extract(h, '(?i)({MONTHS})', 1)")}), lambda m: NOT list_contains(list_transform(
       regexp_extract_all(f, '(?i)\\b(?:{MONTHS})\\b'), lambda g: {MCODE.format(m='g')}), m))) AS months FROM audited""")


@query("answer_audit", S.with_views("qa", AUDITED, BAD, body="""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS answers,
   count(*) FILTER (nums = 0 AND months = 0) AS grounded, sum(nums)::BIGINT AS bad_numbers, sum(months)::BIGINT AS bad_months,
   sum(length(a))::BIGINT AS chars FROM bad GROUP BY ALL"""))
def answer_audit(spark, d):
    return Q.answer_audit(audited(spark, d))


@query("grounding_check", S.with_views("qa", AUDITED, BAD, body="SELECT conv_id, turn, nums = 0 AND months = 0 AS grounded, nums AS bad_numbers, months AS bad_months FROM bad"))
def grounding_check(spark, d):
    a = audited(spark, d).withColumn("r", N.grounding_report(T.extract_answer("raw"), F.col("facts")))
    nums, months = F.size("r.numbers").cast("bigint"), F.size("r.months").cast("bigint")
    return a.select("conv_id", "turn", ((nums == 0) & (months == 0)).alias("grounded"),
                    nums.alias("bad_numbers"), months.alias("bad_months"))


@query("confusion_matrix", """SELECT count(*) FILTER (NOT e AND NOT g) AS tp, count(*) FILTER (e AND g) AS tn, count(*) FILTER (e AND NOT g) AS fp,
   count(*) FILTER (NOT e AND g) AS fn, round(avg((e = g)::INT), 6) AS accuracy FROM (
     SELECT quality = 1 AS e, length(text) >= 1000 AS g FROM labels JOIN documents USING (doc_id))""")
def confusion_matrix(spark, d):
    labels = V.table(spark, d, "labels").join(V.documents(spark, d), "doc_id")
    return G.confusion_matrix(labels.select((F.col("quality") == 1).alias("expect"),
                                            (F.length("text") >= 1000).alias("got")))


@query("probe_pass_rate", S.with_views("qa", body=f"""SELECT conv_id, count(*) AS probes, round(avg((ok AND NOT contains(answer, 'the '))::INT), 6) AS pass_rate
   FROM (SELECT *, len(ws) = 0 OR list_bool_or(list_transform(ws, lambda w: contains(answer, w))) AS ok
     FROM (SELECT *, {S.words('question')} AS ws FROM qa)) GROUP BY conv_id"""))
def probe_pass_rate(spark, d):
    """Every word of a question is a phrase one of which its answer must hold."""
    p = V.qa_pairs(spark, d).withColumn("ok", G.probe_pass(F.col("answer"), T.words("question"), F.array(L("the "))))
    return p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("pass_rate"))
