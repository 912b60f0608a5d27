"""Rule classification: label columns over text, windows and questions."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import text as T
from recollect.functions.text import ALNUM, col, contains_any, starts_any


def _text_tags(low):
    """Which rules have a word in a lower-case text, as bits."""
    if low is None:
        return 0
    return sum(1 << i for i, (_, in_text, _) in enumerate(rules.TAG_RULES) if any(w in low for w in in_text))


def _starts(words):
    """Two tables over pairs of bytes: bit i says that the pair begins the i-th word (of 64) and that
    it may follow there."""
    first, second = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    for i, w in enumerate(words):
        bit = np.uint64(1 << i % 64)
        first[w[0] | w[1] << 8] |= bit
        second[w[2] | (np.arange(256) if len(w) == 3 else w[3]) << 8] |= bit
    return first, second


TAG_WORDS = [(i, w.encode()) for i, (_, in_text, _) in enumerate(rules.TAG_RULES) for w in in_text]  # of three bytes at least


def _tags_of_batch(texts):
    """`_text_tags` of all texts of a batch at once: the first four bytes of all words are looked for
    at all places together, and what begins like a word is compared with it."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    out = np.zeros(len(texts), np.int32)
    if at[-1] == at[0]:
        return pa.array(out)
    data = np.concatenate([np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]], np.zeros(3, np.uint8)])
    at = at - at[0]
    pairs = data[:-1] | data[1:].astype(np.uint16) << 8
    first, second = _starts([w for _, w in TAG_WORDS])  # not kept: a megabyte that would go with every function
    marks = first[pairs[:-2]] & second[pairs[2:]]
    begins = np.flatnonzero(marks)
    marks = marks[begins]
    for i, (tag, w) in enumerate(TAG_WORDS):
        here = begins[marks & np.uint64(1 << i % 64) != 0]
        row = np.searchsorted(at, here, "right") - 1
        inside = here + len(w) <= at[row + 1]
        here, row = here[inside], row[inside]
        for j, b in enumerate(w):
            same = data[here + j] == b
            here, row = here[same], row[same]
        out[row] |= 1 << tag
    return pa.array(out)


def auto_tag(text, app, title, in_batches=False):
    """K1: tags in fixed order.

    A text is searched for its some eighty words by Python, several times faster than by one
    `contains` each; a hundred rows at a time, so that no task holds more whole texts. in_batches: by Arrow batches, whose size
    the caller bounds; faster still where the text itself comes out of Python, as in a stream that scrubs it."""
    search = F.arrow_udf(_tags_of_batch, "int") if in_batches else F.udf(_text_tags, "int", useArrow=False)
    found = search(F.lower(col(text)))
    low = F.struct(found.alias("t"), *[F.lower(col(x)).alias(n) for n, x in (("a", app), ("w", title))])

    def marks(x):
        return F.array_compact(F.array(*[
            F.when(contains_any(x["a"], in_app) | contains_any(x["w"], in_app) | (
                x["t"].bitwiseAND(1 << i) != 0), F.lit(tag))
            for i, (tag, _, in_app) in enumerate(rules.TAG_RULES)]))

    return T.let(low, marks)


def activity_category(app, title):
    """K4: coarse kind of activity as a past-tense phrase."""
    low = F.struct(F.lower(col(app)).alias("a"),
                   F.lower(F.concat(col(app), F.lit(" "), col(title))).alias("full"))

    def label(x):
        a, full = x["a"], x["full"]
        web = (F.when(contains_any(full, rules.VIDEO_SITES), F.lit("watched videos"))
               .when(contains_any(full, rules.MUSIC_SITES), F.lit("listened to music"))
               .otherwise(F.lit("browsed the web")))
        return (F.when(contains_any(a, rules.BROWSERS), web)
                .when(contains_any(a, rules.EDITORS), F.lit("worked on code"))
                .when(contains_any(full, rules.CHAT_SITES), F.lit("chatted in messengers"))
                .otherwise(F.lit("worked in apps")))

    return T.let(low, label)


def needs_web(q):
    """K5: refusal first, then local-only topics, then live topics."""
    q = F.lower(col(q))
    return (F.when(contains_any(q, rules.WEB_REFUSED), False)
            .when(contains_any(q, rules.WEB_LOCAL_ONLY), False)
            .otherwise(contains_any(q, rules.WEB_WANTED)))


def is_activity_recall(q):
    """K6."""
    return contains_any(F.lower(col(q)), rules.RECALL_PHRASES)


def is_screen_query(q):
    """K7: recall, a screen phrase, or an activity word about oneself."""
    low = F.lower(col(q))
    self_word = low.rlike(rf"(?<![{ALNUM}])(?:{'|'.join(rules.SCREEN_SELF_WORDS)})(?![{ALNUM}])")
    return (is_activity_recall(q) | contains_any(low, rules.SCREEN_PHRASES)
            | (contains_any(low, rules.SCREEN_ACTIVITY_WORDS)
               & (self_word | contains_any(low, rules.SCREEN_OPEN_CUES))))


def _bare(q):
    return T.trim_ws(F.regexp_replace(F.lower(col(q)), f"[^{ALNUM} ]", ""))


def asks_user_name(q):
    """K8."""
    return (_bare(q).isin(rules.NAME_QUESTIONS_EXACT)
            | contains_any(F.lower(col(q)), rules.NAME_QUESTIONS))


def asks_identity(q):
    """K8."""
    return (_bare(q).isin(rules.IDENTITY_QUESTIONS_EXACT)
            | contains_any(F.lower(col(q)), rules.IDENTITY_QUESTIONS))


def asks_about_secrets(q):
    """K9."""
    low = F.lower(col(q))
    return contains_any(low, rules.SECRET_WORDS) & contains_any(low, rules.SECRET_ABOUT_STORE)


def report_days(q):
    """Days a requested report covers, or NULL."""
    low = F.lower(col(q))
    return F.when(contains_any(low, rules.REPORT_VERBS),
                  F.when(low.contains("week"), 7).when(low.contains("month"), 30).otherwise(1))


def _first_word(c):
    return T.trim_alnum(F.lower(F.get(T.words(c), 0)))


def person_in_question(q):
    """The name after the leftmost 'who is', or NULL."""
    rest = F.rtrim(T.after_lead(T.strip_openers(q), rules.PERSON_LEADS), F.lit("?!."))
    return T.let(rest, lambda r: F.when(
        (F.size(T.words(r)) > 0) & ~_first_word(r).isin(rules.PERSON_STOP_FIRST), T.trim_ws(r)))


def about_subject(q):
    """The subject after the leftmost 'about', or NULL."""
    rest = F.rtrim(T.after_lead(T.strip_openers(q), rules.ABOUT_LEADS), F.lit("?!."))
    rest = F.regexp_replace(T.trim_ws(rest), r"\A(?:the )+", "")
    rest = T.trim_ws(F.regexp_replace(rest, r"\A(?:a )+", ""))
    return T.let(rest, lambda r: F.when(
        F.size(T.words(r)).between(1, 6) & (F.length(r) <= 60)
        & ~_first_word(r).isin(rules.ABOUT_STOP_FIRST), r))


def entity_in_question(q):
    return F.coalesce(person_in_question(q), about_subject(q))


def named_entity(q):
    """K11, K12, else the capitalised words of a factual question."""
    bare = T.strip_openers(q)
    later = T.let(T.words(bare), lambda ws: F.slice(ws, F.lit(2), F.size(ws)))
    toks = F.transform(later, lambda w: F.regexp_replace(w, f"^[^{ALNUM}-]+|[^{ALNUM}-]+$", ""))
    names = F.filter(toks, lambda w: w.rlike(r"\A\p{Lu}") & w.rlike(r"\p{Ll}") & (F.length(w) >= 3))
    proper = F.when(starts_any(F.lower(bare), rules.FACT_LEADS),
                    F.nullif(F.array_join(names, " "), F.lit("")))
    return F.coalesce(entity_in_question(q), proper)


def entity_statement(q):
    """struct(kind, value) of a statement about the person spoken of, or NULL."""
    base = F.rtrim(T.trim_ws(q), F.lit(".!"))

    def without_no(b):
        first = F.regexp_replace(F.substring_index(F.lower(b), " ", 1), f"[^{ALNUM}]", "")
        negated = b.contains(" ") & first.rlike(r"\Ano[nope]*\z")
        after = F.substring(b, F.instr(b, " "), F.length(b))
        return F.when(negated, T.trim_ws(F.ltrim(after, F.lit(" ,")))).otherwise(T.trim_ws(b))

    def statement(body):
        low = F.lower(body)

        def tail(lead):
            return F.nullif(T.trim_ws(T.after_lead(body, [lead])), F.lit(""))

        def fact(leads, articles):
            v = F.nullif(T.trim_ws(F.regexp_replace(
                body, rf"(?i)\A(?:{T.literal_pattern(leads)})", "")), F.lit(""))
            for art in articles:
                v = F.regexp_replace(v, rf"\A(?:{art} )+", "")
            return F.when(starts_any(low, leads),
                          T.strip_trailing_command(T.trim_ws(v)))

        rename = F.coalesce(*[tail(lead) for lead in rules.RENAME_LEADS])
        clarifies = starts_any(low, rules.CLARIFY_LEADS)
        value = F.when(clarifies, fact(rules.CLARIFY_LEADS, ["the", "a"])).otherwise(
            fact(rules.DESCRIBE_LEADS, ["a", "an"]))
        return F.struct(rename.alias("rename"), value.alias("fact"))

    return T.let(T.let(T.let(base, without_no), statement), lambda s:
                 F.when(s["rename"].isNotNull(),
                        F.struct(F.lit("rename").alias("kind"), s["rename"].alias("value")))
                 .when(s["fact"].isNotNull(),
                       F.struct(F.lit("fact").alias("kind"), s["fact"].alias("value"))))


def query_route(q, has_entity=None):
    """Label of the first route that takes a question."""
    taught = entity_statement(q).isNotNull()
    if has_entity is not None:
        taught = taught & has_entity
    return (F.when(taught, F.lit("taught"))
            .when(report_days(q).isNotNull(), F.lit("report"))
            .when(asks_about_secrets(q), F.lit("secrets"))
            .when(is_activity_recall(q), F.lit("recall"))
            .when(asks_identity(q), F.lit("identity"))
            .when(asks_user_name(q), F.lit("name"))
            .otherwise(F.lit("model")))


def is_followup(q, has_previous):
    """Refers back, given that something came before."""
    q = col(q)
    toks = F.transform(T.words(F.lower(q)), T.trim_alnum)
    refers = F.exists(toks, lambda t: t.isin(rules.REFERENCE_WORDS))
    short = (F.size(T.words(q)) <= 2) & q.rlike(r"[\x{400}-\x{4FF}]")
    return has_previous & (refers | short)


def unanswerable_followup(q, has_facts, offline, web):
    """A third-person question our facts cannot answer and the web did not."""
    low = F.lower(T.trim_ws(q))
    asked = low.endswith("?") | starts_any(low, rules.FOLLOWUP_STARTS)
    no_web = offline | (T.trim_ws(F.coalesce(col(web), F.lit(""))) == "")
    return no_web & asked & contains_any(low, rules.THIRD_PERSON_CUES) & has_facts


def is_game_path(path):
    """The file stem is a known game, or the path shows an anti-cheat."""
    low = F.lower(col(path))
    name = F.regexp_extract(low, r"([^/\\]*)\z", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    return stem.isin(rules.GAME_EXES) | contains_any(low, rules.ANTICHEAT_HINTS)


def is_code_editor(app):
    """Apps where a single changed line matters."""
    return contains_any(F.lower(col(app)), rules.TIGHT_HASH_APPS)


def parse_reminder(c):
    """The text of the first reminder marker, or NULL."""
    found = F.regexp_extract(col(c), r'(?s)\[ACTION: REMIND\("(.*?)"\)\]', 1)
    return F.nullif(T.trim_ws(found), F.lit(""))


def entity_grounded(name, facts):
    """Some part of the name of 3 letters or more occurs in the facts."""
    hay = F.lower(col(facts))
    toks = F.filter(F.transform(T.words(name), lambda w: F.lower(T.trim_alnum(w))),
                    lambda w: F.length(w) >= 3)
    return F.exists(toks, lambda t: hay.contains(t))


def enrich_with_city(term, city, question):
    """Add the city to a location-type term that lacks it."""
    term, city = col(term), col(city)
    place = (contains_any(F.lower(term), rules.LOCATION_WORDS)
             | contains_any(F.lower(col(question)), rules.LOCATION_WORDS))
    add = city.isNotNull() & place & ~F.lower(term).contains(F.lower(city))
    return F.when(F.coalesce(add, F.lit(False)), F.concat(term, F.lit(" "), city)).otherwise(term)


def resolve_reference(q, referent):
    """A command whose object is a pronoun, with the referent put in; or NULL."""
    q, referent = T.trim_ws(q), col(referent)

    def with_words(ws):
        low = F.transform(ws, lambda w: F.lower(T.trim_alnum(w)))
        return T.let(F.struct(ws.alias("ws"), low.alias("low")), place)

    def place(x):
        ws, low, n = x["ws"], x["low"], F.size(x["ws"])

        def linked(i):
            return F.coalesce(F.get(low, i - 1), F.lit("")).isin(rules.CONNECTORS)

        def takes(i):
            w = F.get(low, i)
            return w.isin(rules.PRONOUNS) & (linked(i) | (i == n - 1)
                                             | (w.isin(rules.POSSESSIVES) & (i + 1 < n)))

        spots = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), takes)

        def put(at):
            weak = F.get(low, at).isin(rules.WEAK_PRONOUNS) & ~linked(at)
            return F.when(at.isNotNull() & ~weak, F.array_join(F.transform(
                ws, lambda w, i: F.when(i == at, referent).otherwise(w)), " "))

        return T.let(F.get(spots, F.lit(0)), put)

    ok = starts_any(F.lower(q), rules.COMMAND_STARTS) & (T.trim_ws(referent) != "")
    return F.when(ok, T.let(T.words(q), with_words))


def _capitalized_run(c):
    ws = F.filter(F.transform(T.words(c), T.trim_alnum), lambda w: w != "")
    zero = F.struct(*[F.lit(0).alias(k) for k in ("i", "cs", "cl", "bs", "bl")])

    def step(a, w):
        cap = w.rlike(r"\A\p{Lu}")
        cs = F.when(cap & (a["cl"] == 0), a["i"]).otherwise(a["cs"])
        cl = F.when(cap, a["cl"] + 1).otherwise(0)
        better = cap & (cl >= a["bl"])
        return F.struct((a["i"] + 1).alias("i"), cs.alias("cs"), cl.alias("cl"),
                        F.when(better, cs).otherwise(a["bs"]).alias("bs"),
                        F.when(better, cl).otherwise(a["bl"]).alias("bl"))

    return T.let(F.struct(ws.alias("ws"), F.aggregate(ws, zero, step).alias("best")), lambda x: F.when(
        (x["best"]["bl"] > 0) & ~((x["best"]["bl"] == 1) & (x["best"]["bs"] == 0)),
        F.array_join(F.slice(x["ws"], x["best"]["bs"] + 1, x["best"]["bl"]), " ")))


def referent_of(question):
    """What an earlier question was about, or NULL when it names nothing."""
    p = F.rtrim(T.trim_ws(question), F.lit("?!.,"))
    low = F.lower(p)
    lead_pat = rf"(?is)\A(?:{T.literal_pattern(rules.REFERENT_LEADS)})"
    after_lead = F.when(low.rlike(lead_pat), T.trim_ws(F.regexp_replace(p, lead_pat, "")))
    after_about = F.when(low.contains(" about "), T.trim_ws(
        F.regexp_extract(p, r"(?is)\A.* about (.*)\z", 1)))
    cand = F.coalesce(after_lead, after_about, _capitalized_run(p))
    tail = rules.CONNECTORS + rules.REFERENT_TAIL_WORDS
    toks = T.let(T.words(F.btrim(cand, F.lit("\"'«»"))), lambda ws: F.array_join(F.slice(
        ws, F.lit(1), T.last_place(ws, lambda w: ~F.lower(w).isin(tail))), " "))
    return T.let(toks, lambda t: F.when(
        F.length(t).between(2, 60) & (F.size(F.split(t, " ")) <= 6)
        & ~F.lower(t).isin(rules.PRONOUNS)
        & ~T.trim_alnum(F.lower(F.substring_index(t, " ", 1))).isin(rules.NON_ENTITY_FIRST), t))
