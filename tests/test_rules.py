"""Literal cases for the rule classification and reference resolution."""
import pytest

from recollect.functions import classify as K
from recollect.functions import text as T


def test_tags(value):
    assert value(K.auto_tag, "fn main() paid invoice", "spotify", "") == ["#code", "#work", "#finance", "#entertainment"]
    assert value(K.auto_tag, "hello", "x", "y") == []
    assert value(K.auto_tag, "", "Visual Studio Code", "") == ["#code"]


def test_category(value):
    assert value(K.activity_category, "chrome", "Twitch") == "watched videos"
    assert value(K.activity_category, "chrome", "Spotify") == "listened to music"
    assert value(K.activity_category, "firefox", "x") == "browsed the web"
    assert value(K.activity_category, "zed", "") == "worked on code"
    assert value(K.activity_category, "Discord", "") == "chatted in messengers"
    assert value(K.activity_category, "Player", "") == "worked in apps"


def test_needs_web(values):
    assert values(K.needs_web, ["latest news", "latest news offline", "explain the news", "hello there"]) == \
        [True, False, False, False]


def test_screen_query(values):
    assert values(K.is_screen_query, [
        "what video am i watching", "which browser is fastest", "which browser is open", "what did i do today",
        "what's on my screen", "is this site big", "i'm watching a video", "mime video"]) == \
        [True, False, True, True, True, False, True, False]


def test_identity(values):
    assert values(K.asks_user_name, ["Who am I?!", "hm, what's my name", "who is karla"]) == [True, True, False]
    assert values(K.asks_identity, ["who are you", "please tell me your name", "who are those"]) == [True, True, False]


def test_secrets_and_reports(values):
    assert values(K.asks_about_secrets, ["do you have my old password", "how long is a good password"]) == [True, False]
    assert values(K.report_days, ["write a report on this week", "make a report: month so far", "now write a doc", "the report"]) == \
        [7, 30, 1, None]


def test_entities(values):
    assert values(K.person_in_question, [
        "hey who is Ivo Brandt?", "who is she", "who is the oldest", "so, who was Teodora.", "what is rye"]) == \
        ["Ivo Brandt", None, None, "Teodora", None]
    assert values(K.about_subject, [
        "tell me about lichen", "ok, do you know about the canal?", "tell me about yourself", "tell me about them",
        "info about one two three four five six seven"]) == ["lichen", "canal", None, None, None]
    assert values(K.named_entity, [
        "what is the Moreau-Lind inequality", "what is HTTP", "explain tides", "when did Lisbon burn"]) == \
        ["Moreau-Lind", None, None, "Lisbon"]


@pytest.mark.parametrize("q,kind,val", [
    ("he is a chess coach, find him", "fact", "chess coach"), ("his nickname is Moth", "rename", "Moth"),
    ("no his name is Moth.", "rename", "Moth"), ("nope, i mean the tall rower", "fact", "tall rower"),
    ("she's an architect", "fact", "architect"), ("what is basalt", None, None), ("a list about him", None, None)])
def test_statements(value, q, kind, val):
    s = value(K.entity_statement, q)
    assert (s and (s["kind"], s["value"]) or (None, None)) == (kind, val)


@pytest.mark.parametrize("q,prev,want", [
    ("open video about her", "who is Ines Kato", "open video about Ines Kato"),
    ("play him", "tell me about Ravel", "play Ravel"),
    ("open video about her", "how old is Ines Kato", "open video about Ines Kato"),
    ("what do you say about him", "who is Ines Kato", None), ("open the map", "who is Ines Kato", None),
    ("open video about her", "who is she", None), ("open video about her", "well then", None),
    ("find his new book", "who is Oduya", "find Oduya new book"), ("play him", "what did I do yesterday", None)])
def test_back_references(spark, q, prev, want):
    df = spark.createDataFrame([(q, prev)], "q string, prev string").withColumn("ref", K.referent_of("prev"))
    assert df.select(K.resolve_reference("q", "ref").alias("v")).first()["v"] == want


def test_games_and_reminders(values):
    assert values(K.is_game_path, ["c:\\g\\cs2.exe", "/x/codec.exe", "c:\\vgc\\a.exe", "d:\\cod.exe"]) == \
        [True, False, True, True]
    assert values(K.parse_reminder, [
        'x [ACTION: REMIND(" call ")] y', "IDLE", '[ACTION: REMIND("")]', '[ACTION: REMIND("a")][ACTION: REMIND("b")]',
        '[ACTION: REMIND("open']) == ["call", None, None, "a", None]


def test_city(spark):
    rows = [("weather", "Astana", "weather", "weather Astana"), ("weather", None, "weather", "weather"),
            ("weather astana", "Astana", "q", "weather astana"), ("rust", "Astana", "rust", "rust"),
            ("today", "Oslo", "any news", "today Oslo")]
    df = spark.createDataFrame(rows, "t string, c string, q string, want string")
    for r in df.select("want", K.enrich_with_city("t", "c", "q").alias("got")).collect():
        assert r["got"] == r["want"]


def test_followups(spark):
    df = spark.createDataFrame([("tell me more", True), ("tell me more", False), ("rust?", True), ("да", True)],
                               "q string, p boolean")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(K.is_followup("q", F.col("p"))).collect()] == [True, False, False, True]


def test_long_runs_do_not_recurse(values):
    """Blanks, connectives and connectors in any number, which a repeated group could not walk."""
    n = 50_000
    out = values(T.strip_trailing_command, [
        "Foo" + " " * n + "and", "Foo ,. and, then. " + "so " * n, "and " * n, "Foo" + "\n\t , " * n + "please", " " * n, "Foo and" + " x" * n,
        "Foo" + "," * n, "Foo . and"])
    assert out == ["Foo", "Foo", "", "Foo", "", "Foo and" + " x" * n, "Foo", "Foo"]
    assert values(K.referent_of, ["who is Ann" + " of" * n, "tell me about " + "by " * n, "about " * n, "what is Foo Bar mean like OF?"]) == [
        "Ann", None, None, "Foo Bar"]
    assert values(K.query_route, ["he is tall" + " and" * n, "who is he" + " with" * n]) is not None


def test_texts_are_searched_for_tags_outside_of_columns(spark):
    """One search step for all words instead of a column function for each."""
    rows = spark.createDataFrame([("GIT \u0130 zoom", "x", "y"), (None, "Code", None), ("git", None, "y")], "t string, a string, w string")
    out = rows.select(K.auto_tag("t", "a", "w").alias("tags"))
    assert [r["tags"] for r in out.collect()] == [["#code", "#work"], ["#code"], []]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "traceback" not in plan


def test_tag_counts_hold_a_total_for_each_tag(spark):
    from recollect.operators import rollup as G
    rows = spark.createDataFrame([("x", ["#code", "#work"]), ("y", ["#code"]), ("y", ["#code"]), (None, ["#work"]), ("z", [])], "app_name string, tags array<string>")
    got = sorted(map(tuple, G.tag_counts(rows).select("app_name", "tag", "n").collect()), key=repr)
    assert got == sorted([("x", "#code", 1), ("y", "#code", 2), (None, "#code", 3),
                          ("x", "#work", 1), (None, "#work", 1), (None, "#work", 2)], key=repr)


def test_texts_are_searched_for_tags_in_batches(spark):
    """The search of whole batches finds what the search of each text finds, and takes no `contains` for each word."""
    import random

    import pyarrow as pa
    from pyspark.sql import functions as F
    from recollect import rules
    pick = random.Random(4)
    words = [w for _, in_text, _ in rules.TAG_RULES for w in in_text]
    bits = ["", " ", "x", "é", "日", "car", "tas", "gi", "fn", "stack trac", "error", "e", "k"] + words
    texts = [None, "", "t", "ta", "tax", "fn", "fn ", *words, *[w[:-1] for w in words], *[w[1:] for w in words]]
    texts += ["".join(pick.choices(bits, k=pick.randint(0, 4))) for _ in range(2000)]
    batch = pa.array(["zz", *texts]).slice(1)
    assert K._tags_of_batch(batch).to_pylist() == [K._text_tags(x) for x in texts]
    assert K._tags_of_batch(pa.array([None, ""], pa.string())).to_pylist() == [0, 0]
    rows = spark.createDataFrame([("GIT İ zoom", "x", "y"), (None, "Code", None), ("git", None, "y")], "t string, a string, w string")
    out = rows.select(K.auto_tag("t", "a", "w", in_batches=True).alias("tags"))
    assert [r["tags"] for r in out.collect()] == [["#code", "#work"], ["#code"], []]
    assert "traceback" not in out._jdf.queryExecution().executedPlan().toString()
