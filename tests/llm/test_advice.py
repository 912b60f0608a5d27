"""What the contract tests leave open: each test here fails on the code before its change."""

import hashlib
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import functions as F
from test_contracts import SMALL, rows_of

from recollect.llm import html, sharding
from recollect.llm.language import classify, encoders, identify, is_held_out, learn
from recollect.llm.queries import QUERIES


# 3 sharding

def brute_tied(keys, shards, replicas):
    """The zero-slack law over points named by shard and number."""
    at = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    ring = sorted((at(f"shard-{s}-{r}"), s) for s in range(shards) for r in range(replicas))
    places, arcs = [p for p, _ in ring], defaultdict(list)
    for p, k in sorted((at(str(k)), k) for k in keys):
        arcs[bisect_left(places, p) % len(ring)].append(k)
    even, more = divmod(len(keys), shards)
    room, out = [even + (s < more) for s in range(shards)], {}
    for a in range(len(ring)):
        for k in arcs[a]:
            j = a
            while not room[ring[j % len(ring)][1]]:
                j += 1
            out[k] = ring[j % len(ring)][1]
            room[out[k]] -= 1
    return out


def test_a_further_shard_moves_few_keys(spark):
    keys = spark.range(2000).selectExpr("id doc_id", "id size", "id text_crc32")
    old, new = ({r["doc_id"]: r["shard"] for r in rows_of(sharding.assign(keys, n, tied=True))} for n in (24, 25))
    assert old == brute_tied(range(2000), 24, 64) and new == brute_tied(range(2000), 25, 64)
    assert sum(old[k] != new[k] for k in old) < 0.12 * len(old)  # the least is one in 25


def test_sharding_query_uses_the_tied_ring(spark):
    ids = [r["doc_id"] for r in rows_of(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id"))]
    assert len(set(ids)) == len(ids)
    assert {r["doc_id"]: r["shard"] for r in rows_of(QUERIES["op3_sharding"](spark, SMALL))} == brute_tied(ids, 24, 64)


# 10 language

def test_short_texts_find_their_language(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 50 or doc_id % 7 = 0")
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~is_held_out())
    got = [r for r in rows_of(identify(df.select("doc_id", "text", F.col("lang").alias("truth")), train)) if r["lang_pred"] != "und"]
    for rows in (got, [r for r in got if len(r["text"]) < 50]):
        assert len(rows) > 5 and sum(r["accepted"] for r in rows) >= 0.9 * len(rows)
        assert sum(r["accepted"] and r["lang_pred"] == r["truth"] for r in rows) >= 0.85 * len(rows)


def test_ties_of_whole_bytes_are_measured_again(spark):
    models = encoders(learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(~is_held_out())))
    tie = "Anouble thwh."
    assert len({len(m.compress(tie.lower().encode())) for _, m, _ in models}) == 1
    assert classify(tie, models)[0] == "en" and classify(tie, models)[1] >= 0.005


# 6 extraction

LONG = ["The first paragraph of the article, long enough, with commas, to count.", "Another one, also long, which belongs to it, of course."]
BODY = "".join(f"<p>{x}</p>" for x in LONG)


def test_wrapped_articles_stay():
    form = f'<body><form id="aspnetForm"><label>Find</label><input><button>Go</button><div class="search">Search</div><h1>T</h1>{BODY}</form></body>'
    for page in (form, form.replace("form", "fieldset"), f'<body><div class="content has-sidebar"><h2>T</h2>{BODY}</div></body>',
                 f'<body><article class="post category-social"><h2>T</h2>{BODY}</article></body>'):
        assert html.main_text(page).split("\n\n") == ["T", *LONG], page
    furniture = f'<form><p>Sign up, now.</p></form><div class="promo"><p>Buy this.</p></div><div class="comments">{"<p>Nice, I like it.</p>" * 30}</div>'
    page = f'<body><div class="content has-sidebar"><h2>T</h2>{BODY}{furniture}</div></body>'
    assert html.main_text(page).split("\n\n") == ["T", *LONG]


def test_siblings_between_sections_stay():
    more = "<ul><li>Item</li></ul><section><p>Short one.</p></section><pre>code</pre><table><tr><td>Cell</td></tr></table>"
    links = "<ul><li><a href=a>Elsewhere</a></li></ul>"
    page = f"<body><section>{BODY * 4}</section>{more}{links}<section>{BODY * 2}</section></body>"
    assert html.main_text(page).split("\n\n") == LONG * 4 + ["Item", "Short one.", "code", "Cell"] + LONG * 2


# 6 pages

def body(*parts, tag="article"):
    return f"<html><body><{tag}>{parts[0]}</{tag}>{''.join(parts[1:])}</body></html>"


def test_many_reader_comments_do_not_win():
    comment = "<div class='comment'><p>I read this, and I think, all in all, that it is a very fine piece, really.</p></div>"
    short = "<p>A short article, of one paragraph only, about a small thing that happened today.</p>"
    for title in ("", "<h1>Title</h1>"):
        for wrap in ("<section class='comments'>{}</section>", "<div id='comment-list'>{}</div>", "<ol class='commentlist x'>{}</ol>"):
            got = html.main_text(body(title + short, wrap.format(comment * 60)))
            assert "A short article" in got and "I read this" not in got
    assert "A short article" in html.main_text(f"<body><div class='has-comments'>{short}</div></body>")


def test_parts_at_the_ends_of_an_article_stay():
    para = "<p>" + "A sentence, with commas, that goes on and on, as they do, to gather points. " * 4 + "</p>"
    page = f"<body><div class='page'><pre>first code</pre><ul><li>first item</li></ul>{para * 3}<section><p>Short end.</p></section><ol><li>last item</li></ol></div></body>"
    got = html.main_text(page)
    assert all(x in got for x in ("first code", "first item", "Short end.", "last item"))


def test_article_parts_named_like_furniture_stay():
    para = "<p>" + "A sentence, with commas, that goes on and on, as they do, to gather points. " * 4 + "</p>"
    inside = f"<h1>T</h1>{para * 3}<div class='warning'><p>Mind the gap.</p></div><section class='related-work'><p>Others did this.</p></section>"
    links = "<div class='related'><a href=a>Another story</a> <a href=b>One more</a></div><div class='share'>Share</div>"
    got = html.main_text(body(inside + links, "<div class='warning'><p>Site notice.</p></div>"))
    assert "Mind the gap." in got and "Others did this." in got
    assert not any(x in got for x in ("Another story", "Share", "Site notice."))


# 10 letters

def test_numerals_are_no_letters():
    models = encoders({"en": b"some words of english", "de": b"einige deutsche worte"})
    for text in ("\u00bd \u00b2 \u2460", "\u2167 \u2173", "12 _ 3.4", "", "\u00b3\u00be"):
        assert classify(text, models) == ("und", 0.0)
    assert classify("\u00bd a", models)[0] != "und" and classify("\u6f22", models)[0] != "und"
