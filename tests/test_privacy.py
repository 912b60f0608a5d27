"""Secrets: literal cases, invariants, and the two word-list paths."""
import random
import re

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import privacy as R
from recollect.operators import redact as X

HEX40, HEX48 = "ab12" * 10, "ab12" * 12


def test_tokens(values):
    ins = ["key sk-abcdefghijklmnopqrst end", "\tGHP_0123456789abcdefgh\n", f"0x{HEX40} {HEX40} {HEX48}",
           "sk-short", "ask-abcdefghijklmnopqrstuv", "  two  spaces "]
    assert values(R.scrub_tokens, ins) == [
        "key [key redacted] end", "\t[key redacted]\n", f"[key redacted] {HEX40} [key redacted]",
        "sk-short", ins[4], ins[5]]


def test_token_length_counts_bytes(values):
    t = "sk-" + "é" * 9   # 12 characters, 21 bytes
    assert values(R.scrub_tokens, [t, "sk-" + "é" * 8]) == ["[key redacted]", "sk-" + "é" * 8]


def test_cards(values):
    ins = ["card 4242 4242 4242 4242 exp", "order 1234567890123456 shipped", "4242-4242-4242-4242", "4242  4242 4242 4242",
           "x4242424242424242y", "1" * 40]
    assert values(R.scrub_cards, ins) == [
        "card [card redacted] exp", ins[1], "[card redacted]", ins[3], "x[card redacted]y", ins[5]]


def test_long_digit_lists_do_not_overflow(values):
    text = " ".join("7" for _ in range(60_000))
    assert values(R.scrub_cards, [text]) == [text]


def test_scrub_is_idempotent(spark, values):
    ins = ["key sk-abcdefghijklmnopqrst", "4242 4242 4242 4242", "plain"]
    once = values(R.scrub_plain, ins)
    assert values(R.scrub_plain, once) == once


def test_windows(spark):
    rows = [("MetaMask", "chrome", True), ("My 1Password vault", "x", True), ("main.rs", "Code", False),
            ("Online Banking", "edge", True), ("a video", "vlc", False)]
    df = spark.createDataFrame(rows, "t string, a string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", R.is_private_window("t", "a")).collect())


def test_seal_round_trip(spark):
    key, other = F.lit("k" * 32), F.lit("o" * 32)
    df = spark.createDataFrame([("secret é text",), ("",), ("x" * 500,)], "x string").withColumn("s", R.seal("x", key))
    r = df.select((R.open_sealed("s", key) == F.col("x")).alias("ok"), (R.open_sealed("x", key) == F.col("x")).alias("plain"),
                  (R.open_sealed("s", other) == "").alias("bad"), (R.open_sealed("s", None) == "").alias("nokey"),
                  (R.open_sealed(F.concat("s", F.lit("A")), key) == "").alias("tampered"),
                  F.col("s").contains("\n").alias("broken")).collect()
    assert all(x.ok and x.plain and x.bad and x.nokey and x.tampered and not x.broken for x in r)


WORDS = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]


def cases(spark):
    run12, run24 = " ".join(WORDS[:12]), " ".join(WORDS[:24])
    texts = [f"my phrase {run12} end", run24, " ".join(WORDS[:11]), f"keep\tthis  {run12.upper()}\nnext   line",
             "five of them " + " ".join(WORDS[:5]), f"{run12} x1 {run12}", run12.replace(" ", "  "), "a\n\nb",
             " ".join(WORDS[:6]) + "\n" + " ".join(WORDS[:6])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(w,) for w in WORDS], "word string")


def test_seed_phrases_both_paths(spark):
    docs, words = cases(spark)
    m = rules.SEED_MARK
    want = [f"my phrase {m} end", m, " ".join(WORDS[:11]), f"keep this {m}\nnext   line",
            "five of them " + " ".join(WORDS[:5]), f"{m} x1 {m}", m, "a\n\nb",
            " ".join(WORDS[:6]) + "\n" + " ".join(WORDS[:6])]
    for size in (1000, 3):   # a shared set, and the join for lists beyond the bound
        out = X.scrub_seed_phrases(docs, words, "doc_id", max_set=size).orderBy("doc_id").collect()
        assert [r["text"] for r in out] == want


def test_log_lines(values):
    assert values(R.redact_log_line, ["a search: cats", "MEDIA_PLAY x search: y", "tick", "fallback → z"]) == \
        ["a search: […]", "MEDIA_PLAY x search: […]", "tick", "fallback → […]"]


def test_word_list_reaches_every_scrubber(spark):
    run = " ".join(WORDS[:12])
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    rows = spark.createDataFrame([(1, 1, f"copied {run}"), (1, 2, "a plain copied text")], "stream long, seq long, text string") \
        .withColumn("time_start", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert [r["seq"] for r in X.clipboard_filter(rows, words).collect()] == [2]
    assert X.clipboard_filter(rows, words.limit(0)).count() == 2
    flags = X.contains_secret(rows, words, "seq").orderBy("seq").collect()
    assert [r["secret"] for r in flags] == [True, False]
    log = X.log_tail_redacted(rows.select("seq", F.col("text").alias("line")), 5, words).orderBy("seq").collect()
    assert log[0]["line"] == f"copied {rules.SEED_MARK}"


def test_seed_runs_are_found_where_lines_are_read(spark):
    """No token is shuffled or sorted, and both ways agree, also where keys repeat or are null."""
    words = spark.createDataFrame([(w,) for w in "abcdefghijklmnop"], "word string")
    run = "a b c d e f g h i j k l m"
    rows = [(1, f"{run}\nx1 {run.upper()} z9 {run}  n"), (2, f"q {run}"), (2, f"q {run}"), (None, run), (None, "a b"), (3, None), (4, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = docs.filter("doc_id in (1, 3, 4)")
    plan = X.seed_runs(once, words, "doc_id")._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
    assert X.seed_runs(once, words, "doc_id").count() == 3
    small, joined = (sorted(map(str, X.seed_runs(docs, words, "doc_id", max_set=n).collect())) for n in (100, 1))
    assert small == joined and len(small) >= 3


def test_runs_of_tokens():
    r, words = random.Random(5), {"a", "b", "mid\x1cword"}
    for _ in range(2000):
        toks = [r.choice(["a", "B", "a", "b", "x", "a1"] if r.random() < .2 else ["a", "B"]) for _ in range(r.randrange(60))]
        for least in (1, 3, 12):
            hit = "".join("1" if t.lower() in words else "0" for t in toks)
            assert X._runs_of(toks, words, least) == [(m.start(), len(m.group())) for m in re.finditer("1+", hit) if len(m.group()) >= least]
    for c in "\x1c\x1d\x1e\x1f":
        assert X._tokens(f" a{c}b c\t") == [f"a{c}b", "c"]


def test_texts_are_scrubbed_in_small_batches(spark):
    """Texts go to Python a hundred rows at a time, not ten thousand whole ones in an Arrow batch."""
    docs = spark.createDataFrame([(1, " ".join(["word"] * 12)), (2, None), (3, "word " * 11)], "doc_id long, text string")
    out = X.scrub_seed_phrases(docs, spark.createDataFrame([("word",)], "word string"), "doc_id")
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rules.SEED_MARK, 2: None, 3: "word " * 11}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
