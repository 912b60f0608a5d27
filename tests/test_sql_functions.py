"""The SQL functions agree with the column functions."""
from conftest import SMALL
from pyspark.sql import functions as F

from recollect.functions import numbers as N
from recollect.functions import privacy as R
from recollect.functions import sql
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.sources import views


def test_text_functions(spark):
    sql.register(spark)
    docs = views.table(spark, SMALL, "documents").select(F.concat(
        "text", F.lit(" 活 4242 4242 4242 4242 sk-abcdefghijklmnopqrstu \u00a0 • it's 1,000.5\n\n x")).alias("text"))
    pairs = {"mem_clean_lines": T.clean_lines, "mem_clean_noise": T.clean_noise_chars, "mem_strip_cjk": T.strip_cjk,
             "mem_squeeze": T.squeeze, "mem_word_set": T.word_set, "mem_number_tokens": N.number_tokens,
             "mem_redact_tokens": R.scrub_tokens, "mem_redact_cards": R.scrub_cards}
    same = docs.select(*[(F.expr(f"{n}(text)") == fn("text")).alias(n) for n, fn in pairs.items()])
    bad = same.select(*[F.count_if(~F.col(n)).alias(n) for n in pairs]).first().asDict()
    assert bad == {n: 0 for n in pairs}
    assert docs.select(F.count_if(F.expr("mem_redact_cards(text)") != F.col("text"))).first()[0] == docs.count()


def test_time_functions(spark):
    sql.register(spark)
    e = views.table(spark, SMALL, "events")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    assert e.filter((F.expr("mem_hour_bucket(ts)") != C.hour_bucket("ts"))
                    | (F.expr("mem_week_bucket(ts)") != C.week_bucket("ts"))
                    | (F.expr("mem_rel_age(ts, timestamp_ntz'2024-02-01 00:00:00')") != C.rel_age("ts", now))).count() == 0


def test_rules(spark):
    """The rule functions of SQL and of columns agree on every turn and question."""
    from recollect.functions import classify as K
    sql.register(spark)
    extra = spark.createDataFrame([(t,) for t in (
        'ok [ACTION: REMIND(" call mom ")] end', "c:\\games\\cs2.exe", "/usr/bin/valorant.x64", "D:\\EAC\\start", "1,000.50", "007", "x", "", None,
        "hey, what is my name", "and so on", "(quoted)", "what did i do today on the screen", "weekly report please", "write a report for the month")],
        "text string")
    q = views.asks(spark, SMALL).select("text").unionByName(extra)
    pairs = {"needs_web": K.needs_web, "is_activity_recall": K.is_activity_recall, "is_screen_query": K.is_screen_query,
             "asks_user_name": K.asks_user_name, "asks_identity": K.asks_identity, "asks_about_secrets": K.asks_about_secrets,
             "report_days": K.report_days, "is_game_path": K.is_game_path, "is_code_editor": K.is_code_editor,
             "parse_reminder": K.parse_reminder, "strip_openers": T.strip_openers, "trim_alnum": T.trim_alnum,
             "is_blacklisted_title": R.is_blacklisted_title, "num_value": lambda c: N.num_value(F.col(c)), "num_core": lambda c: N.num_core(F.col(c)),
             "redact_log_line": R.redact_log_line}
    bad = q.select(*[F.count_if(~F.expr(f"mem_{n}(text)").eqNullSafe(fn("text"))).alias(n) for n, fn in pairs.items()]).first().asDict()
    assert bad == {n: 0 for n in pairs}


def test_window_and_day_functions(spark):
    from recollect.functions import classify as K
    from recollect.plans.dedup import windows
    sql.register(spark)
    w = windows(spark, SMALL)
    pairs = [("mem_activity_category(app, title)", K.activity_category("app", "title")), ("mem_is_private_window(title, app)", R.is_private_window("title", "app")),
             ("mem_is_messenger_noise(app, title)", R.is_messenger_noise("app", "title"))]
    for text, column in pairs:
        assert w.filter(~F.expr(text).eqNullSafe(column)).count() == 0
    e = views.table(spark, SMALL, "events")
    now = F.lit("2024-01-20 10:11:12").cast("timestamp_ntz")
    assert e.filter(F.expr("mem_when_word(ts, timestamp_ntz'2024-01-20 10:11:12')") != C.when_word("ts", now)).count() == 0
    assert e.filter(F.expr("mem_midnight_cutoff(ts, 3)") != C.local_midnight_cutoff("ts", 3)).count() == 0
