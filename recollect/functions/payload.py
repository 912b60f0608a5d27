"""Column functions on the JSON payload of memory rows."""

from pyspark.sql import functions as F

from recollect import rules
from recollect.functions.text import col

SUB_EVENT = "struct<t:bigint,act:string,ocr_full:string,clipboard:string>"
DELTA = "struct<t:bigint,text:string>"


def parsed(payload):
    """The payload as a variant, or NULL when it is not JSON."""
    return F.try_parse_json(col(payload))


def string_field(v, name):
    """A field only if it is a string; other types count as absent."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING",
                  F.try_variant_get(v, f"$.{name}", "string"))


def json_text(payload, v=None):
    """The text, or the raw payload."""
    v = parsed(payload) if v is None else v
    return F.coalesce(string_field(v, "text"), col(payload))


def json_app(payload, v=None):
    v = parsed(payload) if v is None else v
    return F.coalesce(string_field(v, "app_name"), F.lit(""))


def json_title(payload, v=None):
    v = parsed(payload) if v is None else v
    return F.coalesce(string_field(v, "window_title"), F.lit(""))


def sub_event_text(e):
    return F.coalesce(F.nullif(e["ocr_full"], F.lit("")), F.nullif(e["clipboard"], F.lit("")))


def text_preview(payload, v=None, n=200):
    """A short preview of a raw, hour or week record."""
    payload = col(payload)
    v = parsed(payload) if v is None else v
    subs = F.try_variant_get(v, "$.sub_events", f"array<{SUB_EVENT}>")
    from_subs = F.array_join(F.filter(F.transform(subs, sub_event_text),
                                      lambda t: t.isNotNull()), " ")
    has_summary = F.try_variant_get(v, "$.summary", "variant").isNotNull()
    named = F.when(has_summary, string_field(v, "summary")).otherwise(string_field(v, "text"))
    return F.substring(F.when(subs.isNotNull(), from_subs)
                       .otherwise(F.coalesce(named, payload)), 1, n)


def is_screen_app(app):
    """J4 on an app column: a named app that is not an internal one."""
    app = col(app)
    return F.coalesce(app.isNotNull() & ~app.isin(rules.NON_SCREEN_APPS), F.lit(False))


def is_screen_event(payload, v=None):
    """The payload names an app that is not an internal one."""
    v = parsed(payload) if v is None else v
    return is_screen_app(string_field(v, "app_name"))


def is_qa_event(payload, v=None):
    """A stored question/answer pair."""
    v = parsed(payload) if v is None else v
    return F.coalesce(string_field(v, "app_name") == "dialogue", F.lit(False))


def parse_qa(c):
    """struct(question, answer) of a stored pair, or NULL if malformed."""
    from recollect.functions.text import trim_ws
    c = col(c)
    q_at = F.instr(c, "Q: ")
    rest = F.substring(c, q_at + 3, F.length(c))
    a_at = F.instr(rest, "\nA: ")
    pair = F.struct(trim_ws(F.substring(rest, F.lit(1), a_at - 1)).alias("question"),
                    trim_ws(F.substring(rest, a_at + 4, F.length(rest))).alias("answer"))
    return F.when((q_at > 0) & (a_at > 0), pair)


def sub_event(t_micros, app, text):
    """One entry of an hour record; clipboard text has its own slot."""
    app = F.coalesce(col(app), F.lit("screen"))
    text = F.coalesce(col(text), F.lit(""))
    clip = app == "clipboard"
    return F.struct(t_micros.alias("t"), app.alias("act"),
                    F.when(clip, F.lit("")).otherwise(text).alias("ocr_full"),
                    F.when(clip, text).otherwise(F.lit("")).alias("clipboard"))
