"""The main functions as SQL functions of a session.

``register(spark)`` creates temporary SQL functions, which Spark inlines into the
plan like any expression; none of them calls Python."""

import re

from recollect import rules
from recollect.functions import numbers as N
from recollect.functions import privacy as R
from recollect.functions import text as T


def lit(s):
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def has(x, words):
    """Whether a text holds any of the words."""
    return f"{x} RLIKE {lit(T.literal_pattern(words))}"


def among(x, words):
    return f"{x} IN ({', '.join(map(lit, words))})"


def rules_on_text():
    """K rows on one text: name -> (result type, body)."""
    low = "lower(q)"
    bare = f"btrim(regexp_replace({low}, {lit(f'[^{T.ALNUM} ]')}, ''), {lit(T.WS_CHARS)})"
    recall = has(low, rules.RECALL_PHRASES)
    own = lit(rf"(?<![{T.ALNUM}])(?:{'|'.join(rules.SCREEN_SELF_WORDS)})(?![{T.ALNUM}])")
    name = f"regexp_extract({low}, {lit(r"([^/\\]*)\z")}, 1)"
    stem = f"regexp_replace({name}, {lit(r"(?<=.)\.[^.]*\z")}, '')"
    openers = "|".join(re.escape(w.rstrip(",")) + ",?" * w.endswith(",") for w in rules.OPENERS)
    return {
        "needs_web": ("BOOLEAN", f"CASE WHEN {has(low, rules.WEB_REFUSED)} THEN false WHEN {has(low, rules.WEB_LOCAL_ONLY)} THEN false "
                                 f"ELSE {has(low, rules.WEB_WANTED)} END"),
        "is_activity_recall": ("BOOLEAN", recall),
        "is_screen_query": ("BOOLEAN", f"{recall} OR {has(low, rules.SCREEN_PHRASES)} OR ({has(low, rules.SCREEN_ACTIVITY_WORDS)} "
                                       f"AND ({low} RLIKE {own} OR {has(low, rules.SCREEN_OPEN_CUES)}))"),
        "asks_user_name": ("BOOLEAN", f"{among(bare, rules.NAME_QUESTIONS_EXACT)} OR {has(low, rules.NAME_QUESTIONS)}"),
        "asks_identity": ("BOOLEAN", f"{among(bare, rules.IDENTITY_QUESTIONS_EXACT)} OR {has(low, rules.IDENTITY_QUESTIONS)}"),
        "asks_about_secrets": ("BOOLEAN", f"{has(low, rules.SECRET_WORDS)} AND {has(low, rules.SECRET_ABOUT_STORE)}"),
        "report_days": ("INT", f"CASE WHEN {has(low, rules.REPORT_VERBS)} THEN CASE WHEN contains({low}, 'week') THEN 7 "
                               f"WHEN contains({low}, 'month') THEN 30 ELSE 1 END END"),
        "is_game_path": ("BOOLEAN", f"{among(stem, rules.GAME_EXES)} OR {has(low, rules.ANTICHEAT_HINTS)}"),
        "is_code_editor": ("BOOLEAN", has(low, rules.TIGHT_HASH_APPS)),
        "parse_reminder": ("STRING", f"nullif(btrim(regexp_extract(q, {lit(REMINDER)}, 1), {lit(T.WS_CHARS)}), '')"),
        "strip_openers": ("STRING", f"regexp_replace(btrim(q, {lit(T.WS_CHARS)}), {lit(rf'\A(?i:(?:{openers}) ){T.WS}*')}, '')"),
        "trim_alnum": ("STRING", f"regexp_replace(q, {lit(f'^[^{T.ALNUM}]+|[^{T.ALNUM}]+$')}, '')"),
        "is_blacklisted_title": ("BOOLEAN", has(low, rules.TITLE_BLACKLIST)),
        "num_value": ("DOUBLE", "try_cast(replace(q, ',', '') AS DOUBLE)"),
        "num_core": ("STRING", "coalesce(nullif(regexp_replace(regexp_replace(q, '[^0-9]', ''), '^0+', ''), ''), "
                               "if(q IS NULL, NULL, '0'))"),
    }


REMINDER = r'(?s)\[ACTION: REMIND\("(.*?)"\)\]'


def bodies():
    """name -> (parameters, result type, body)."""
    full = "lower(concat(app, ' ', title))"
    web = (f"CASE WHEN {has(full, rules.VIDEO_SITES)} THEN 'watched videos' WHEN {has(full, rules.MUSIC_SITES)} THEN 'listened to music' "
           "ELSE 'browsed the web' END")
    when = "(unix_micros(cast(now AS timestamp)) - unix_micros(cast(ts AS timestamp))) div 1000000"
    return {
        **{f"mem_{n}": ("q STRING", kind, body) for n, (kind, body) in rules_on_text().items()},
        **older_bodies(),
        "mem_activity_category": ("app STRING, title STRING", "STRING",
                                  f"CASE WHEN {has('lower(app)', rules.BROWSERS)} THEN {web} WHEN {has('lower(app)', rules.EDITORS)} THEN 'worked on code' "
                                  f"WHEN {has(full, rules.CHAT_SITES)} THEN 'chatted in messengers' ELSE 'worked in apps' END"),
        "mem_is_private_window": ("title STRING, app STRING", "BOOLEAN",
                                  f"{has('lower(title)', rules.PRIVATE_WINDOW_MARKERS)} OR {has('lower(app)', rules.PRIVATE_WINDOW_MARKERS)}"),
        "mem_is_messenger_noise": ("app STRING, title STRING", "BOOLEAN",
                                   f"{has('lower(app)', rules.MESSENGER_APPS)} AND NOT ({has('lower(title)', rules.WORK_TITLE_WORDS)})"),
        "mem_when_word": ("ts TIMESTAMP_NTZ, now TIMESTAMP_NTZ", "STRING",
                          f"CASE WHEN {when} < 86400 THEN 'Today' WHEN {when} < 172800 THEN 'Yesterday' ELSE 'Recently' END"),
        "mem_midnight_cutoff": ("now TIMESTAMP_NTZ, days INT", "TIMESTAMP_NTZ",
                                "cast(timestamp_micros(unix_micros(date_trunc('day', cast(now AS timestamp))) "
                                "- cast(greatest(days - 1, 0) AS bigint) * 86400000000) AS TIMESTAMP_NTZ)"),
        "mem_redact_log_line": ("x STRING", "STRING", "CASE " + " ".join(
            f"WHEN instr(x, {lit(m)}) > 0 THEN concat(substring(x, 1, instr(x, {lit(m)}) - 1), {lit(m.rstrip() + ' […]')})"
            for m in rules.LOG_CONTENT_MARKERS) + " ELSE x END"),
    }


def older_bodies():
    """T, C, N and R rows."""
    trim = f"btrim({{}}, {lit(T.WS_CHARS)})".format
    words = f"filter(split(x, {lit(T.WS + '+')}), w -> w <> '')"
    token = (f"octet_length(p) >= {rules.TOKEN_MIN_BYTES} AND (p RLIKE {lit(R.PREFIX)} OR p RLIKE {lit(R.HEX_TOKEN)})")
    digits = "regexp_replace(p, '[ -]', '')"
    card = (f"p RLIKE '^[0-9]' AND length({digits}) BETWEEN {rules.CARD_MIN_DIGITS} AND {rules.CARD_MAX_DIGITS} "
            f"AND luhn_check({digits})")
    age = "(unix_micros(cast(now AS timestamp)) - unix_micros(cast(ts AS timestamp))) div 1000000"
    return {
        "mem_clean_lines": ("x STRING", "STRING",
                            f"array_join(filter(transform(split(x, '\\n'), l -> {trim('l')}), l -> l <> ''), '\\n')"),
        "mem_clean_noise": ("x STRING", "STRING", f"regexp_replace(x, {lit(T.NOISE)}, '')"),
        "mem_strip_cjk": ("x STRING", "STRING", f"regexp_replace(x, {lit(T.CJK_CLASS)}, '')"),
        "mem_squeeze": ("x STRING", "STRING", f"array_join({words}, ' ')"),
        "mem_word_set": ("x STRING", "ARRAY<STRING>",
                         f"array_distinct(transform(filter({words}, w -> octet_length(w) > 2), w -> lower(w)))"),
        "mem_number_tokens": ("x STRING", "ARRAY<STRING>", f"regexp_extract_all(x, {lit(N.NUMBER)}, 1)"),
        "mem_redact_tokens": ("x STRING", "STRING",
                              f"array_join(transform(split(x, {lit(R.SPACE_EDGE)}), p -> if({token}, {lit(rules.KEY_MARK)}, p)), '')"),
        "mem_redact_cards": ("x STRING", "STRING",
                             f"array_join(transform(split(x, {lit(R.DIGIT_RUN_EDGE)}), p -> if({card}, {lit(rules.CARD_MARK)}, p)), '')"),
        "mem_hour_bucket": ("ts TIMESTAMP_NTZ", "BIGINT", "unix_micros(cast(ts AS timestamp)) div 3600000000"),
        "mem_week_bucket": ("ts TIMESTAMP_NTZ", "BIGINT", "unix_micros(cast(ts AS timestamp)) div 604800000000"),
        "mem_rel_age": ("ts TIMESTAMP_NTZ, now TIMESTAMP_NTZ", "STRING",
                        f"CASE WHEN {age} < 90 THEN 'just now' WHEN {age} < 3600 THEN concat({age} div 60, ' min ago') "
                        f"WHEN {age} < 86400 THEN concat({age} div 3600, ' h ago') WHEN {age} < 172800 THEN 'yesterday' "
                        f"ELSE concat({age} div 86400, ' d ago') END"),
    }


def register(spark):
    for name, (params, result, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
