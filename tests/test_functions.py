"""Literal cases for the text, payload, number and time functions."""
from pyspark.sql import functions as F

from recollect.functions import numbers as N
from recollect.functions import payload as J
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators import web as H


def test_clean_lines(values):
    assert values(T.clean_lines, ["a\n\n  b \n\t\nc", "", "  \n ", "one"]) == ["a\nb\nc", "", "", "one"]


def test_noise_and_markers(values):
    assert values(T.clean_noise_chars, ["• Привет □ ok—1", "★★"]) == [" Привет  ok—1", ""]
    assert values(T.strip_markers, ["## Head\nSCREEN x\n  ## sub\ny (level 1+)"]) == ["x\ny "]


def test_strip_cjk(value):
    assert value(T.strip_cjk, "run 活动 now", "English") == "run  now"
    assert value(T.strip_cjk, "活动", "Chinese") == "活动"


def test_unicode_space(values):
    assert values(T.trim_ws, ["\u00a0\u2003x\u3000"]) == ["x"]
    assert values(lambda c: F.size(T.words(c)), ["a\u00a0b\u2003c", "  ", ""]) == [3, 0, 0]


def test_code_summary(values):
    code = "pub fn a() {\n    let x = 1;\n    fn inner() {}\n}\nuse b;\n"
    out = values(T.summarize_code, ["x" * 501, "fn a() {\n body\n}\nlast", code, "} }\nfn z() {\n q\n}"])
    assert out[0] == "x" * 500
    assert out[1] == "fn a() {\nlast\n"
    assert out[2] == "pub fn a() {\n    fn inner() {}\nuse b;\n"
    assert out[3] == "} }\nfn z() {\n"


def test_titles(values, value):
    assert values(T.strip_leading_count, ["(20) Page", "(x) Page", "() Page", " (3)Page"]) == \
        ["Page", "(x) Page", "() Page", "Page"]
    assert value(T.activity_line, "firefox", "(2) Cats - YouTube — Mozilla Firefox") == "watched «Cats» on YouTube"
    assert value(T.activity_line, "chrome", "YouTube - Google Chrome") == "was on YouTube"
    assert value(T.activity_line, "chrome", "") == "browsing the web"
    assert value(T.activity_line, "chrome", "My page") == "opened «My page» in the browser"
    assert value(T.activity_line, "Code", "a.rs - Visual Studio Code") == "worked in VS Code: a.rs"
    assert value(T.activity_line, "explorer.exe", "Docs") == "File Explorer: Docs"
    assert value(T.activity_line, "Player", "") == "in Player"


def test_documents(value, values):
    assert values(T.sanitize_stem, ["../../etc", "", "a:b  c", "x" * 60]) == ["etc", "idea", "a b c", "x" * 50]
    assert value(lambda c: T.report_title(c, F.lit("FB")), "**Title:** Week one") == "Week one"
    assert value(lambda c: T.report_title(c, F.lit("FB")), "x" * 61) == "FB"
    r = value(lambda c: T.split_title_body(c, F.lit("raw text")), "\n# Title\n\nbody\nmore")
    assert (r["title"], r["body"]) == ("Title", "body\nmore")
    r = value(lambda c: T.split_title_body(c, F.lit("raw text")), "  ")
    assert (r["title"], r["body"]) == ("raw text", "")


def test_extract_answer(values):
    assert values(T.extract_answer, [
        "<think>t</think><answer> hi </answer>", "<think>a<answer>b</think>rest", "<answer>cut",
        "x<think>never", "plain", "<think>q</think>tail</answer>"]) == \
        ["hi", "rest", "cut", "x", "plain", "tail"]


def test_openers_and_tails(values):
    assert values(T.strip_openers, ["hi who", "hey, who", "hive", "and so on"]) == ["who", "who", "hive", "so on"]
    assert values(T.strip_trailing_command, [
        "a singer, find him", "a streamer and then look her up now", "dota 2 player", "a poet, and please"]) == \
        ["a singer", "a streamer", "dota 2 player", "a poet"]


def test_word_set(value):
    assert sorted(value(T.word_set, "The cat the CAT is on é éé")) == ["cat", "the", "éé"]


def test_payload(values):
    docs = ['{"app_name":"Code","text":"t"}', '{"app_name":5,"text":7}', "broken", '{"window_title":"w"}',
            '{"sub_events":[{"ocr_full":"a","clipboard":""},{"ocr_full":"","clipboard":"b"}]}',
            '{"summary":"s","text":"t"}']
    assert values(J.json_text, docs) == ["t", docs[1], "broken", docs[3], docs[4], "t"]
    assert values(J.json_app, docs) == ["Code", "", "", "", "", ""]
    assert values(J.text_preview, docs) == ["t", docs[1], "broken", docs[3], "a b", "s"]
    assert values(J.is_screen_event, docs) == [True, False, False, False, False, False]
    apps = [f'{{"app_name":"{a}"}}' for a in ("dialogue", "Dialogue", "clipboard", "user")]
    assert values(J.is_screen_event, apps) == [True, True, False, False]
    assert values(J.is_qa_event, apps) == [True, False, False, False]


def test_parse_qa(values):
    out = values(J.parse_qa, ["Q: a\nb\nA: c\nd", "A: x", "Q: only", "Q: \nA: z"])
    assert [None if r is None else tuple(r) for r in out] == [("a\nb", "c\nd"), None, None, ("", "z")]


# (answer, facts, whether every figure of the answer stands in the facts)
CASES = [
    ("The bike was 740 euros", "paid 740.00 for a bike", True), ("2,350 steps so far", "steps: 2350", True),
    ("ratio 0.125", "a ratio of 0.125 was read", True), ("on March 8 the lamp broke", "March 8: lamp", True),
    ("take 3 eggs and 7 spoons", "", True), ("we may see rain", "", True), ("train at 17:45", "17:45 platform", True),
    ("nothing to count", "", True), ("The bike was 7400 euros", "paid 740 for a bike", False),
    ("born in 1987", "moved in 2011", False), ("the lamp broke on March 8", "it broke on April 8", False),
    ("router at 192.168.4.21", "no router named", False),
]


def test_grounding_cases(spark):
    df = spark.createDataFrame(CASES, "answer string, facts string, expect boolean")
    rows = df.select("answer", "expect", N.is_grounded("answer", "facts").alias("got")).collect()
    assert [r["answer"] for r in rows if r["expect"] != r["got"]] == []


def test_grounding_set_form_agrees(spark):
    from recollect.operators.joins import grounding_antijoin
    df = spark.createDataFrame([(i, a, f) for i, (a, f, _) in enumerate(CASES)], "k int, answer string, facts string")
    row = {r["k"]: sorted(set(r["n"])) for r in df.select(
        "k", N.ungrounded_numbers("answer", "facts").alias("n")).collect() if r["n"]}
    got = {}
    for r in grounding_antijoin(df, "k", "answer", "facts").collect():
        got.setdefault(r["k"], []).append(r["tok"])
    assert {k: sorted(v) for k, v in got.items()} == row


def test_grounding_set_form_agrees_on_documents(spark):
    """Numbers of any size: documents hold card numbers beyond 9e12."""
    from conftest import SMALL

    from recollect.operators.joins import grounding_antijoin
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(
        F.col("doc_id").alias("k"), F.col("text").alias("answer"), F.expr("substring(text, length(text) div 2)").alias("facts"))
    row = {(r["k"], n) for r in docs.select("k", N.ungrounded_numbers("answer", "facts").alias("n")).collect() for n in r["n"]}
    got = {(r["k"], r["tok"]) for r in grounding_antijoin(docs, "k", "answer", "facts").collect()}
    assert got == row and any(len(n) > 12 for _, n in row)


def test_cache_serves_only_cached_questions(spark):
    """The second question is served, so the third finds nothing within the time."""
    from recollect.operators.dedup import jaccard_cache_join
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:04:00"), (3, 1, "2024-01-01 00:06:00"),
            (4, 2, "2024-01-01 00:06:30"), (5, 1, "2024-01-01 00:08:00")]
    df = spark.createDataFrame([(*r, "where is the blue bag") for r in rows], "query_id long, conv_id long, ts string, text string")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for limit in (100, 2):
        got = sorted((r["query_id"], r["hit_id"]) for r in jaccard_cache_join(df, "conv_id", limit=limit).collect())
        assert got == [(2, 1), (5, 3)]


def test_neighbours_without_full_vectors(spark):
    from recollect.operators.retrieval import knn
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [0.0, 1.0]), (6, [1.0])],
                                 "seq long, embedding array<float>")
    ask = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [])], "query_id long, embedding array<float>")
    for most in (None, 0):
        assert [(r["query_id"], r["seq"]) for r in knn(rows, ask, 5, max_shared=most).orderBy("rank").collect()] == [(1, 1), (1, 5)]


def test_buckets_and_ages(spark):
    df = spark.createDataFrame([(0,), (1_800_000_000,), (3_600_000_000,), (604_800_000_000,), (-1,)], "us long")
    df = df.withColumn("ts", C.from_micros(F.col("us")))
    rows = df.select(C.hour_bucket("ts").alias("h"), C.week_bucket("ts").alias("w")).collect()
    assert [(r.h, r.w) for r in rows] == [(0, 0), (0, 0), (1, 0), (168, 1), (0, 0)]
    ages = [89, 90, 3599, 3600, 86399, 86400, 172800]
    now = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    a = spark.createDataFrame([(x,) for x in ages], "s long").select(
        C.rel_age(C.from_micros(C.micros(now) - F.col("s") * 1_000_000), now).alias("v"),
        C.when_word(C.from_micros(C.micros(now) - F.col("s") * 1_000_000), now).alias("w")).collect()
    assert [r.v for r in a] == ["just now", "1 min ago", "59 min ago", "1 h ago", "23 h ago", "yesterday", "2 d ago"]
    assert [r.w for r in a] == ["Today"] * 5 + ["Yesterday", "Recently"]


PAGE = """<div class="result"><h2><a class="result__a x" href="/1">One <b>bold</b></a></h2><a class=result__snippet>first</a>
<div class="result"><a class="result__a" href="/2">Two</a></div></div>
<div class="other"><a class="result__a" href="/no">no box</a></div></i></p>
<div class="result"><span class="result__snippet">only a snippet</span></div><div class='result'></div>
<a class="result-link" href="/f1">F1</a><td class="result-snippet">s1</td><a class="result-link" href="/f2">F2<br>more</a>
<span class="result-link">not a link</span>"""


def test_both_layouts_of_a_page(spark):
    from recollect.operators import web as H
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>nothing</p>"), (3, None), (4, ""), (5, '<a class="result&#45;link" href=x>by reference</a>'),
                                   (6, '<div class="result">' * 3000 + '<a class="result__a" href="/d">deep</a>' + "</p>" * 3000)], "id int, html string")
    out = {r["id"]: r["r"] for r in pages.select("id", H.page_results("html").alias("r")).collect()}
    triples = lambda rows: [(x["title"], x["href"], x["snippet"]) for x in rows or []]
    assert triples(out[1]["grouped"]) == [("One bold", "/1", "first"), ("Two", "/2", ""), ("", "", "only a snippet"), ("", "", "")]
    assert triples(out[1]["flat"]) == [("F1", "/f1", "s1"), ("F2more", "/f2", "")]
    assert all(not triples(out[i][k]) for i in (2, 3, 4) for k in ("grouped", "flat"))
    assert triples(out[5]["flat"]) == [("by reference", "x", "")]
    assert triples(out[6]["grouped"]) == [("deep", "/d", "")] * 3000


def test_one_python_step_for_both_layouts(spark):
    from recollect.operators import web as H
    pages = spark.createDataFrame([(1, PAGE, "q")], "id int, html string, question string")
    plan = H.fallback_source(pages, "question")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_alias_tables_of_both_sizes(spark):
    from recollect.operators import timeline as W
    rows = spark.createDataFrame([(1, "play spotify and youtube music"), (2, ""), (3, None), (4, "xx a yy"), (5, "日本語 text")], "id int, t string")
    names = spark.createDataFrame([(0, "s", "S", "audio", "spotify"), (0, "s", "S", "audio", "spot"), (1, "y", "Y", "both", "youtube"),
                                   (2, "m", "M", "audio", "youtube"), (3, "one", "", "x", "a"), (4, "jp", "", "x", "本語"), (5, "none", "", "x", "")], W.SERVICE_SCHEMA)
    want = [(1, "m"), (1, "one"), (1, "s"), (1, "y"), (4, "one"), (5, "jp")]
    for share in (1 << 20, 0):
        got = W.alias_hits(rows, F.col("t"), names, share).select("id", "service").collect()
        assert sorted(map(tuple, got)) == want
    assert W.alias_hits(rows, F.col("t"), names.limit(0)).collect() == []


def test_many_aliases(spark):
    from recollect.operators import timeline as W
    rows = spark.range(300).selectExpr("id", "concat('title of item ', id * 331, ' end') AS t")
    names = spark.range(100_000).selectExpr("int(id) AS pos", "'s' AS service", "'' AS label", "'k' AS kind", "concat('item ', id, ' ') AS alias")
    pairs = lambda share: sorted((r["id"], r["pos"]) for r in W.alias_hits(rows, F.col("t"), names, share).collect())
    assert pairs(1 << 24) == pairs(0) == [(i, i * 331) for i in range(300) if i * 331 < 100_000]


def test_aliases_reach_the_driver_in_columns(spark, monkeypatch):
    """No Python row for each alias; repeated rows, several entries of an alias, entries with nulls."""
    from recollect.operators import timeline as W
    rows = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "two"), (3, None)], "id int, t string")
    names = spark.createDataFrame([(0, "s", None, None, "two"), (0, "s", None, None, "two"), (1, "y", "Y", "k", "two"),
                                   (1, "y", "Y", "k", "one"), (2, None, "Z", "k", "one")], W.SERVICE_SCHEMA)
    seen, collect = [], type(names).collect
    with monkeypatch.context() as m:
        m.setattr(type(names), "collect", lambda self: seen.append(self) or collect(self))
        hits = W.alias_hits(rows, F.col("t"), names)
    assert not [rows for rows in seen if "alias" in rows.columns]
    assert sorted((r["id"], r["pos"], r["label"] or "") for r in hits.collect()) == [
        (1, 0, ""), (1, 0, ""), (1, 1, "Y"), (1, 1, "Y"), (1, 2, "Z"), (1, 2, "Z"), (2, 0, ""), (2, 1, "Y")]


def test_tables_of_many_aliases_are_not_handed_out(spark):
    """Above `share` nothing passes the driver; entries with nulls, rows and texts that come twice, aliases of every length."""
    from recollect.operators import timeline as W
    rows = spark.createDataFrame([(1, "x\U0001f600yz abcdefghi"), (1, "x\U0001f600yz abcdefghi"), (2, "abcdefgh"), (3, None), (4, "")], "id int, t string")
    names = spark.createDataFrame([(0, "s", None, None, "\U0001f600y"), (0, "s", None, None, "\U0001f600y"), (0, None, "s", None, "cdefghi"), (1, "a", "", "k", "abcdef"),
                                   (2, "b", "", "k", "abcdefghij"), (3, "c", "", "k", "bcdefgh"), (0, "s", None, None, "h"), (4, "d", "", "k", "")], W.SERVICE_SCHEMA)
    hits = W.alias_hits(rows, F.col("t"), names, 0)
    got = sorted((r["id"], r["pos"], r["service"] or "-") for r in hits.collect())
    assert got == sorted(2 * [(1, 0, "s"), (1, 0, "-"), (1, 1, "a"), (1, 3, "c")] + [(2, 0, "s"), (2, 1, "a"), (2, 3, "c")])
    plan = hits._jdf.queryExecution().executedPlan().toString()  # as it ran
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_pages_are_parsed_in_small_batches(spark):
    """Arrow batches of pages end at a number of bytes, not at ten thousand rows alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    pages = spark.createDataFrame([(1, PAGE, "q")], "id int, html string, question string")
    H.fallback_source(pages, "question")
    assert int(spark.conf.get(name)) <= 4 << 20
