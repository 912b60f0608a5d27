"""Building blocks of the oracle SQL: the derived views and small expressions.

This is the independent statement of each result in plain SQL for DuckDB; no
Spark job uses it.
"""

from recollect import rules
from recollect.sources import views as V


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def has_any(x, words):
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def starts(x, words):
    return "(" + " OR ".join(f"starts_with({x}, {lit(w)})" for w in words) + ")"


def isin(x, words):
    return f"{x} IN ({', '.join(lit(w) for w in words)})"


def case(pairs, default="NULL"):
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


def trim(x):
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def words(x):
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w_: w_ <> '')"


def trim_alnum(x):
    return f"regexp_replace(regexp_replace({x}, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}]+$', '')"


def micros(x):
    return f"epoch_us({x})"


def fmt_ts(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def rel_age(ts, as_of):
    s = f"((epoch_us({as_of}) - epoch_us({ts})) // 1000000)"
    return case([(f"{s} < 90", "'just now'"), (f"{s} < 3600", f"({s} // 60)::VARCHAR || ' min ago'"),
                 (f"{s} < 86400", f"({s} // 3600)::VARCHAR || ' h ago'"),
                 (f"{s} < 172800", "'yesterday'")], f"({s} // 86400)::VARCHAR || ' d ago'")


_TYPE = case([(f"event_type = '{k}'", str(v)) for k, v in V.TYPE_INDEX.items()])
_APP = case([(f"event_type = '{k}'", lit(v)) for k, v in V.APP_BY_TYPE.items()])
_TITLE = """CASE user_id % 4
 WHEN 0 THEN '(3) Clip ' || user_id || ' - YouTube — Mozilla Firefox'
 WHEN 1 THEN 'main_' || user_id || '.py - Visual Studio Code'
 WHEN 2 THEN 'Song ' || user_id || ' | Spotify' ELSE '' END"""
_BASE = f"""event_id::VARCHAR AS id, event_id AS seq, user_id AS stream, ts AS time_start,
 ts AS time_end, 0 AS level, false AS archived, {_APP} AS app_name, {_TITLE} AS window_title"""
_VEC = f"(user_id * 10 + {_TYPE} * 2 + event_id % 2) % (SELECT count(*) FROM embeddings)"


def _ask():
    out = []
    for i, s in enumerate(V.ASK_SHAPES):
        head, _, tail = s.partition("{}")
        out.append((f"shape = {i}", f"{lit(head)} || subject || {lit(tail)}" if "{}" in s else lit(s)))
    return case(out)


VIEWS = {
    "l0": f"SELECT {_BASE} FROM events",
    "l0t": f"""SELECT {_BASE}, coalesce(d.text, '') AS text FROM events e
      LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "l0v": f"""SELECT {_BASE}, v.embedding, v.vec_id AS vec FROM events e
      LEFT JOIN embeddings v ON v.vec_id = {_VEC}""",
    "l0tv": f"""SELECT {_BASE}, coalesce(d.text, '') AS text, v.embedding, v.vec_id AS vec FROM events e
      LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
      LEFT JOIN embeddings v ON v.vec_id = {_VEC}""",
    "clock": "SELECT max(ts) AS as_of FROM events",
    "qa": """SELECT TIMESTAMP '2024-01-01' + to_hours(u.conv_id) + to_minutes(u.turn) AS ts,
      u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
      JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
      WHERE u.role = 'user' AND a.role = 'assistant'""",
    "asks": f"""SELECT conv_id, turn * {V.PARTS} + part AS turn, turn AS of_turn, ts + to_microseconds(part * 1000) AS ts, text FROM (
      SELECT conv_id, turn, 0 AS part, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts, text FROM conversations
      UNION ALL SELECT conv_id, turn, part, ts, {_ask()} FROM (
        SELECT *, (conv_id * 3 + turn * 5 + part) % {len(V.ASK_SHAPES)} AS shape FROM (
          SELECT conv_id, turn, ts, unnest(subs) AS subject, generate_subscripts(subs, 1) AS part FROM (
            SELECT conv_id, turn, TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts,
              list_filter(list_transform(regexp_extract_all(text, '[^.\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS subs
            FROM conversations))))""",
    "questions": """SELECT item_id AS query_id, TIMESTAMP '2024-01-15' + to_minutes(item_id) AS ts,
      b.text, v.vec_id, v.embedding FROM benchmark b
      JOIN embeddings v ON v.vec_id = b.item_id % (SELECT count(*) FROM embeddings)""",
    "metrics": """SELECT CASE WHEN event_id % 2 = 0 THEN 'realtime' ELSE 'stress' END AS scope,
      CASE user_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'store' ELSE 'ttft' END AS metric,
      event_id AS seq, floor(value * 10)::BIGINT AS ms, event_id % 3 = 0 AS is_fresh FROM events""",
    "controls": """SELECT user_id AS stream, ts, event_id AS seq,
      CASE event_type WHEN 'signup' THEN 'consent' WHEN 'error' THEN 'incognito'
        WHEN 'purchase' THEN 'cpu' ELSE 'game' END AS gate,
      CASE WHEN event_type = 'signup' THEN 1.0::DOUBLE WHEN event_type = 'purchase' THEN value
        WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS state
      FROM events WHERE event_type <> 'click'""",
    "cells": f"""SELECT user_id AS stream, ts AS time_start, event_id AS seq, {_APP} AS app_name,
      list_transform(v.embedding, lambda x: floor((x::DOUBLE + 1.0) * 1000)::BIGINT) AS cells
      FROM events e JOIN embeddings v ON v.vec_id = {_VEC}""",
    "blocks": """SELECT vec_id // 4 AS frame, vec_id % 4 AS block, pos - 1 AS pos,
      floor((embedding[pos]::DOUBLE + 1.0) * 1000)::BIGINT AS value
      FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(pos)""",
}


def with_views(*names, body, once=False):
    """A statement that defines the named views (or (name, sql) pairs) first.

    once: every view is computed a single time, however often it is used."""
    how = "AS MATERIALIZED" if once else "AS"
    parts = [f"{n} {how} ({VIEWS[n]})" if isinstance(n, str) else f"{n[0]} {how} ({n[1]})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- the activity phrase (T7-T9) step by step ---------------------------------

_SITE = lambda x: case([(f"contains(lower({x}), {lit(n)})", lit(label)) for n, label in rules.KNOWN_SITES])
_CLEAN = "regexp_replace(trim(window_title), '^\\s*\\([0-9]+\\)\\s*', '')"


def phrase_views(source):
    """Views p1..phrases that add `phrase` and `category` to a view of windows."""
    split = _CLEAN
    for sep in rules.SEPARATORS:
        split = f"replace({split}, {lit(sep)}, chr(1))"
    segs = f"list_filter(list_transform(string_split({split}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    brand = has_any("lower(segs0[-1])", rules.BROWSERS + ["studio code"])
    app = "lower(app_name)"
    full = "(lower(app_name) || ' ' || lower(window_title))"
    pretty = case([("lower(app_name) IN ('explorer', 'explorer.exe')", "'File Explorer'")], "app_name")
    what = "array_to_string(segs, ' — ')"
    web = case([("page IS NOT NULL AND site IS NOT NULL", "'watched «' || page || '» on ' || site"),
                ("page IS NOT NULL", "'opened «' || page || '» in the browser'"),
                ("site IS NOT NULL", "'was on ' || site")], "'browsing the web'")
    ed = case([(f"contains({app}, 'code')", "'VS Code'")], pretty)
    phrase = case([
        (has_any(app, rules.BROWSERS), web),
        (has_any(app, rules.EDITORS),
         f"'worked in ' || {ed} || CASE WHEN {what} = '' THEN '' ELSE ': ' || {what} END")],
        f"CASE WHEN {what} = '' THEN 'in ' || {pretty} ELSE {pretty} || ': ' || {what} END")
    category = case([
        (has_any(app, rules.BROWSERS), case([(has_any(full, rules.VIDEO_SITES), "'watched videos'"),
                                             (has_any(full, rules.MUSIC_SITES), "'listened to music'")],
                                            "'browsed the web'")),
        (has_any(app, rules.EDITORS), "'worked on code'"),
        (has_any(full, rules.CHAT_SITES), "'chatted in messengers'")], "'worked in apps'")
    return [
        ("p1", f"SELECT *, {segs} AS segs0 FROM {source}"),
        ("p2", f"SELECT *, CASE WHEN len(segs0) > 1 AND {brand} THEN segs0[1:len(segs0) - 1] "
               f"ELSE segs0 END AS segs FROM p1"),
        ("p3", f"""SELECT *, coalesce(list_filter(list_transform(segs, lambda s: {_SITE('s')}),
              lambda s: s IS NOT NULL)[1], {_SITE(_CLEAN)}) AS site,
              list_filter(segs, lambda s: {_SITE('s')} IS NULL)[1] AS page FROM p2"""),
        ("phrases", f"SELECT *, {phrase} AS phrase, {category} AS category FROM p3"),
    ]
