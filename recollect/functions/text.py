"""Column functions on text: cleaning, splitting, titles and small parsers."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect import rules

# White space as Unicode defines it (not only the ASCII part).
WS_RANGES = r"\s\x{85}\p{Z}"
WS = f"[{WS_RANGES}]"
WS_CHARS = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ALNUM = r"\p{IsAlphabetic}\p{N}"


def col(c):
    return c if isinstance(c, Column) else F.col(c)


def literal_pattern(words):
    """One regular-expression alternation of literal words, in list order."""
    return "|".join(re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", w) for w in words)


def balanced(op, parts):
    """Combine conditions as a balanced tree, which keeps plans shallow."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [op(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i]
                 for i in range(0, len(parts), 2)]
    return parts[0]


def any_of(conds):
    return balanced(lambda a, b: a | b, conds)


def let(value, body):
    """Bind a value once and use it many times: keeps a rule's expression tree
    small and stops a costly input from being computed per use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_any(c, words):
    """Whether a long text holds any of the words, by plain substring search."""
    return any_of(c.contains(w) for w in words)


def contains_any(c, words):
    """Whether a short text holds any of the words: one alternation, one expression."""
    return c.rlike(literal_pattern(words))


def starts_any(c, words):
    return c.rlike(rf"\A(?:{literal_pattern(words)})")


def trim_ws(c):
    return F.btrim(col(c), F.lit(WS_CHARS))


def ltrim_ws(c):
    return F.ltrim(col(c), F.lit(WS_CHARS))


def trim_alnum(c):
    """Drop everything that is neither letter nor digit from both ends."""
    return F.regexp_replace(col(c), f"^[^{ALNUM}]+|[^{ALNUM}]+$", "")


def lines(c):
    """Lines without their ends; a final line end opens no further line."""
    body = F.regexp_replace(col(c), r"\r?\n\z", "")
    return F.transform(F.split(body, "\n"), lambda l: F.regexp_replace(l, r"\r\z", ""))


def words(c):
    return F.filter(F.split(col(c), WS + "+"), lambda w: w != "")


def squeeze(c):
    return F.array_join(words(c), " ")


def clean_lines(c):
    """Trim every line and drop the blank ones."""
    trimmed = F.transform(F.split(col(c), "\n"), trim_ws)
    return F.array_join(F.filter(trimmed, lambda l: l != ""), "\n")


NOISE = "[^\\p{IsAlphabetic}0-9 \\n\\t.,;:!?\\-—()\"'«»/\\\\@#%&+=<>_]"


def clean_noise_chars(c):
    """Keep letters, ASCII digits and common punctuation."""
    return F.regexp_replace(col(c), NOISE, "")


def strip_markers(c):
    """Drop heading lines and inner level labels."""
    kept = F.filter(lines(c), lambda l: ~ltrim_ws(l).startswith("##"))
    out = F.array_join(kept, "\n")
    for mark in ("SCREEN ", "(level 1+)", "level 1+"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


# The code-point ranges of the scripts removed by strip_cjk.
CJK_RANGES = [(0x3000, 0x303F), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
              (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF00, 0xFFEF)]
CJK_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
CJK_LANGS = ["chin", "japan", "korea"]


def strip_cjk(c, lang=None):
    """T4: remove CJK characters unless the answer language is itself CJK."""
    stripped = F.regexp_replace(col(c), CJK_CLASS, "")
    if lang is None:
        return stripped
    return F.when(contains_any(F.lower(col(lang)), CJK_LANGS), col(c)).otherwise(stripped)


def text_summary(title, app, text):
    """T5: a header with window and app, then the text if there is any."""
    title, app, text = col(title), col(app), col(text)
    bare = title == ""
    head = F.when(bare, F.concat(F.lit("[SCREEN] "), app)).otherwise(
        F.concat(F.lit("[SCREEN] "), title, F.lit(" ("), app, F.lit(")")))
    has_text = F.coalesce(text, F.lit("")) != ""
    return (F.when(has_text, F.concat(head, F.lit("\n"), text))
            .when(bare, F.concat(head, F.lit(": active window"))).otherwise(head))


def summarize_code(c):
    """Code keeps top-level lines and signatures; prose keeps 500 characters."""
    c = col(c)
    is_code = has_any(c, rules.CODE_HINTS)

    def step(acc, line):
        t = trim_ws(line)
        opens = F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit("")))
        closes = F.length(t) - F.length(F.replace(t, F.lit("}"), F.lit("")))
        keep = (acc["depth"] == 0) | (t == "") | starts_any(t, rules.CODE_KEEP_PREFIXES)
        room = F.length(acc["out"]) < 2000
        return F.struct(
            F.greatest(acc["depth"] + opens - closes, F.lit(0)).alias("depth"),
            F.when(keep & room, F.concat(acc["out"], line, F.lit("\n")))
             .otherwise(acc["out"]).alias("out"))

    body = F.aggregate(lines(c), F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")),
                       step, lambda acc: acc["out"])
    empty = c == ""
    return F.when(~is_code | empty, F.substring(c, 1, 500)).otherwise(F.substring(body, 1, 2000))


def strip_leading_count(c):
    """Drop the unread counter browsers put before a title."""
    return F.regexp_replace(col(c), rf"\A{WS}*\([0-9]+\){WS}*", "")


def title_segments(title):
    """Parts of a window title, without a trailing browser or editor brand."""
    t = strip_leading_count(trim_ws(title))
    for sep in rules.SEPARATORS:
        t = F.replace(t, F.lit(sep), F.lit("\x01"))

    def unbranded(segs):
        last = F.lower(F.coalesce(F.get(segs, F.size(segs) - 1), F.lit("")))
        branded = (F.size(segs) > 1) & contains_any(last, rules.BROWSERS + ["studio code"])
        return F.when(branded, F.slice(segs, 1, F.size(segs) - 1)).otherwise(segs)

    return let(F.filter(F.transform(F.split(t, "\x01"), trim_ws), lambda s: s != ""), unbranded)


def sql_string(s):
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_match(c, pairs):
    """Label of the first needle, in list order, that the text holds; else NULL."""
    table = F.expr("array(" + ", ".join(
        f"named_struct('needle', {sql_string(n)}, 'label', {sql_string(l)})" for n, l in pairs) + ")")
    return F.get(F.filter(table, lambda p: c.contains(p["needle"])), F.lit(0))["label"]


def known_site(c):
    return let(F.lower(col(c)), lambda x: first_match(x, rules.KNOWN_SITES))


def is_browser(app):
    return contains_any(F.lower(col(app)), rules.BROWSERS)


def is_editor(app):
    return contains_any(F.lower(col(app)), rules.EDITORS)


def activity_line(app, title):
    """One readable phrase for an (app, window title) pair."""
    app, title = col(app), col(title)
    app_l = F.lower(app)
    pretty = F.when(app_l.isin("explorer", "explorer.exe"), F.lit("File Explorer")).otherwise(app)
    whole_site = known_site(strip_leading_count(trim_ws(title)))

    def web(parts):
        page, site = parts["page"], parts["site"]
        return (F.when(page.isNotNull() & site.isNotNull(),
                       F.concat(F.lit("watched «"), page, F.lit("» on "), site))
                .when(page.isNotNull(), F.concat(F.lit("opened «"), page, F.lit("» in the browser")))
                .when(site.isNotNull(), F.concat(F.lit("was on "), site))
                .otherwise(F.lit("browsing the web")))

    def phrase(segs):
        tagged = F.transform(segs, lambda s: F.struct(s.alias("seg"), known_site(s).alias("site")))
        parts = let(tagged, lambda t: F.struct(
            F.get(F.filter(t, lambda x: x["site"].isNull()), F.lit(0))["seg"].alias("page"),
            F.coalesce(F.get(F.filter(t, lambda x: x["site"].isNotNull()), F.lit(0))["site"],
                       whole_site).alias("site")))
        what = F.array_join(segs, " — ")
        editor = F.when(app_l.contains("code"), F.lit("VS Code")).otherwise(pretty)
        edit = F.when(what == "", F.concat(F.lit("worked in "), editor)).otherwise(
            F.concat(F.lit("worked in "), editor, F.lit(": "), what))
        other = F.when(what == "", F.concat(F.lit("in "), pretty)).otherwise(
            F.concat(pretty, F.lit(": "), what))
        return (F.when(is_browser(app), let(parts, web)).when(is_editor(app), edit)
                .otherwise(other))

    return let(title_segments(title), phrase)


def sanitize_stem(c):
    """A title reduced to a safe file stem."""
    kept = F.regexp_replace(col(c), f"[^{ALNUM} _-]", " ")
    stem = F.trim(F.substring(squeeze(kept), 1, 50))
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit("idea"))


def report_title(c, fallback):
    """A generated first line turned into a title."""
    t = F.btrim(trim_ws(c), F.lit("#*- "))
    t = F.regexp_replace(t, r"\A(?i:title:)", "")
    t = trim_ws(F.btrim(trim_ws(t), F.lit("*#: ")))
    return F.when((t == "") | (F.length(t) > 60), fallback).otherwise(t)


def split_title_body(c, fallback):
    """struct(title, body) of a generated document."""
    c = col(c)

    def parts(ls):
        first = F.array_position(F.transform(ls, lambda l: trim_ws(l) != ""), True).cast("int")
        title = trim_ws(F.ltrim(F.coalesce(F.get(ls, first - 1), F.lit("")), F.lit("#-* ")))
        rest = F.when(first > 0, trim_ws(F.array_join(F.slice(ls, first + 1, F.size(ls)), "\n"))) \
            .otherwise(F.lit(""))
        return F.struct(
            F.when(title == "", F.substring(fallback, 1, 40)).otherwise(F.substring(title, 1, 60))
             .alias("title"),
            F.when(rest == "", trim_ws(c)).otherwise(rest).alias("body"))

    return let(lines(c), parts)


def extract_answer(c):
    """The reply inside a reasoning/answer tagged model output."""
    raw = col(c)
    cut = (F.when(raw.contains("</think>"), F.substring_index(raw, "</think>", -1))
           .when(raw.contains("<think>") & ~raw.contains("<answer>"),
                 F.substring_index(raw, "<think>", 1))
           .otherwise(raw))
    at = F.instr(cut, "<answer>")
    inside = F.substring_index(F.substring(cut, at + 8, F.length(cut)), "</answer>", 1)
    out = F.when(at > 0, inside).otherwise(cut)
    for tag in ("<think>", "</think>", "<answer>", "</answer>"):
        out = F.replace(out, F.lit(tag), F.lit(""))
    return trim_ws(out)


def strip_openers(c):
    """Drop one greeting or filler word from the front."""
    words = [re.escape(w.rstrip(",")) + ",?" * w.endswith(",") for w in rules.OPENERS]
    pat = rf"\A(?i:(?:{'|'.join(words)}) ){WS}*"
    return F.regexp_replace(trim_ws(c), pat, "")


def strip_trailing_command(c):
    """Cut a fact at its imperative tail and drop dangling connectives."""
    cut = F.regexp_replace(col(c), rf"(?is)(?:{literal_pattern(rules.COMMAND_TAILS)}).*\z", "")
    s = trim_ws(F.rtrim(trim_ws(cut), F.lit(",.—-")))

    def dangles(w):
        return F.lower(F.rtrim(w, F.lit(",."))).isin(rules.DANGLING_WORDS) | (w == "")

    def without(x):
        # Pieces between single blanks keep every character's place, so the end of the last
        # piece that stays is a number of characters. Lists have any length; a pattern that
        # repeats a group would recurse.
        n = last_place(x["pieces"], lambda w: ~dangles(w))
        end = F.aggregate(F.slice(x["pieces"], F.lit(1), n), F.lit(0), lambda a, w: a + F.length(w) + 1)
        kept = F.rtrim(F.substring(x["s"], F.lit(1), end - 1), F.lit(",." + WS_CHARS))
        return F.when(n == F.size(x["pieces"]), x["s"]).when(n == 0, F.lit("")).otherwise(kept)

    ends = rf"(?i)(?:\A|{WS})(?:{literal_pattern(rules.DANGLING_WORDS)})[,.]*\z"
    return let(s, lambda t: F.when(~t.rlike(ends), t).otherwise(
        let(F.struct(t.alias("s"), F.split(t, WS).alias("pieces")), without)))


def last_place(items, good):
    """Place (from 1) of the last item that is good; 0 where there is none."""
    back = F.array_position(F.transform(F.reverse(items), good), True).cast("int")
    return F.when(back > 0, F.size(items) - back + 1).otherwise(0)


def truncate_chars(c, n):
    """The first n characters (code points)."""
    return F.substring(col(c), 1, n)


def dedup_lines_topn(memory, web, notice, n=8):
    """Distinct non-blank lines of the preferred source under a notice."""
    memory, web = (F.coalesce(col(x), F.lit("")) for x in (memory, web))
    src = F.when(trim_ws(web) != "", web).otherwise(memory)
    ls = F.slice(F.array_distinct(F.filter(F.transform(F.split(src, "\n"), trim_ws),
                                           lambda l: l != "")), 1, n)
    return F.when(F.size(ls) == 0, F.lit(rules.NO_MATCH_LINE)).otherwise(
        F.concat(F.lit(notice), F.lit("\n\n"), F.array_join(ls, "\n")))


def word_set(c):
    """Distinct lower-case words of more than two bytes."""
    return F.array_distinct(F.transform(
        F.filter(F.split(col(c), WS + "+"), lambda w: F.octet_length(w) > 2), F.lower))


def after_lead(c, leads):
    """Text after the leftmost of the leads, ignoring case; '' when none occurs."""
    return F.regexp_extract(col(c), rf"(?is)\A.*?(?:{literal_pattern(leads)})(.*)\z", 1)
