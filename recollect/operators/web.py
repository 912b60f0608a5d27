"""Jobs over stored web pages: result extraction, links, sources."""

from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions.text import col
from recollect.session import use_small_batches

RESULT = "struct<title:string,href:string,snippet:string>"
LAYOUTS = f"struct<grouped:array<{RESULT}>,flat:array<{RESULT}>>"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
GROUPED = {"box": "result", "title": "result__a", "snippet": "result__snippet"}
FLAT = {"title": "result-link", "snippet": "result-snippet"}


class _Pages(HTMLParser):
    """Both result layouts of a page in one pass, linear in its length.

    A title or snippet is given to the open boxes that lack one as soon as it begins; a text
    is a range of the page's pieces of text."""

    def __init__(self, grouped, flat):
        super().__init__()
        self.grouped, self.flat = grouped, flat
        self.wanted = {*grouped.values(), *flat.values()}
        self.pieces, self.open, self.depth = [], [], Counter()
        self.boxes, self.links, self.snippets = [], [], []
        self.lacks = {"title": [], "snippet": []}  # open boxes, the innermost last

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        classes = set((attrs.get("class") or "").split()) & self.wanted
        item = None
        if classes:
            item = {"href": attrs.get("href") or "", "from": len(self.pieces), "to": None, "title": None, "snippet": None}
            for role, boxes in self.lacks.items():
                if self.grouped[role] in classes:
                    for b in boxes:
                        b[role] = item
                    boxes.clear()
            if self.grouped["box"] in classes:
                self.boxes.append(item)
                if tag not in VOID:
                    for boxes in self.lacks.values():
                        boxes.append(item)
            if self.flat["title"] in classes and tag == "a":
                self.links.append(item)
            if self.flat["snippet"] in classes:
                self.snippets.append(item)
        if tag in VOID:
            if item:
                item["to"] = item["from"]
        else:
            self.open.append((tag, item))
            self.depth[tag] += 1

    def handle_endtag(self, tag):
        if not self.depth[tag]:
            return
        while True:
            name, item = self.open.pop()
            self.depth[name] -= 1
            if item:
                item["to"] = len(self.pieces)
                for boxes in self.lacks.values():
                    if boxes and boxes[-1] is item:
                        boxes.pop()
            if name == tag:
                return

    def handle_data(self, data):
        self.pieces.append(data)

    def text(self, item):
        return "".join(self.pieces[item["from"]:item["to"]]).strip() if item else ""

    def row(self, title, snippet):
        return {"title": self.text(title), "href": title["href"] if title else "", "snippet": self.text(snippet)}

    def results(self):
        pairs = zip(self.links, self.snippets + [None] * len(self.links))
        return {"grouped": [self.row(b["title"], b["snippet"]) for b in self.boxes],
                "flat": [self.row(t, s) for t, s in pairs]}


def _results(html, grouped, flat):
    if not html:
        return {"grouped": [], "flat": []}
    p = _Pages(grouped, flat)
    p.feed(html)
    p.close()
    return p.results()


def page_results(html, grouped=GROUPED, flat=FLAT):
    """H1-H3 parser: results inside containers, and titles and snippets as parallel lists, in
    one pass. A page that cannot hold one of the class names does not reach Python."""
    @F.udf(LAYOUTS, useArrow=True)
    def parse(html):
        return _results(html, grouped, flat)

    html = col(html)
    named = T.contains_any(html, sorted({grouped["box"], *flat.values()}))
    return parse(F.when(named | html.rlike(r"(?i)class\s*=[^&>]*&"), html))


def decode_redirect(href):
    """H4: the real address behind a redirect link."""
    h = T.trim_ws(href)
    enc = F.regexp_extract(h, r"uddg=([^&]*)", 1)
    real = F.try_url_decode(F.replace(enc, F.lit("+"), F.lit("%2B")))
    return (F.when(h.contains("uddg=") & real.isNotNull(), real)
            .when(h.startswith("//"), F.concat(F.lit("https:"), h)).otherwise(h))


def usable(results, question, domain="vk.com", keyword="vk", cap=5):
    """H1/H2 tail: blank results and unwanted domains out, the first five kept,
    links decoded."""
    wants = F.lower(col(question)).contains(keyword)
    kept = F.filter(col(results), lambda r: ((r["title"] != "") | (r["snippet"] != ""))
                    & (wants | ~F.lower(r["href"]).contains(domain)))
    return F.transform(F.slice(kept, 1, cap), lambda r: F.struct(
        r["title"].alias("title"), decode_redirect(r["href"]).alias("url"), r["snippet"].alias("snippet")))


def _parsed(pages):
    use_small_batches(pages.sparkSession)
    return pages.withColumn("_raw", page_results("html"))


def extract_results(pages, question):
    """H1."""
    return _parsed(pages).withColumn("results", usable("_raw.grouped", question)).drop("_raw")


def extract_results_flat(pages, question):
    """H2."""
    return _parsed(pages).withColumn("results", usable("_raw.flat", question)).drop("_raw")


def fallback_source(pages, question):
    """H3: the container layout, or the flat one where it yields nothing."""
    first, second = usable("_raw.grouped", question), usable("_raw.flat", question)
    return _parsed(pages).withColumn("results", F.when(F.size(first) > 0, first).otherwise(second)).drop("_raw")


def domain_filter(links, href, question, domain="vk.com", keyword="vk"):
    """H5 on a link table."""
    return links.filter(F.lower(col(question)).contains(keyword)
                        | ~F.lower(col(href)).contains(domain))


def snippet_lines(results):
    """H6: numbered lines of a result list."""
    return F.array_join(F.transform(col(results), lambda r, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), r["title"], F.lit(": "), r["snippet"], F.lit("\n"))), "")


def first_video_id(html):
    """H8: the first embedded video id, or NULL."""
    return F.nullif(F.regexp_extract(col(html), r'"videoId":"([A-Za-z0-9_-]{11})"', 1), F.lit(""))


def sources_top3(rows, key):
    """The first three web links of each query as Markdown.

    rows: key, pos, title, url; the ranking prunes before it shuffles."""
    links = rows.filter(F.col("url").startswith("http"))
    w = Window.partitionBy(key).orderBy("pos")
    top = links.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 3)
    label = F.when(T.trim_ws("title") == "", F.col("url")).otherwise(F.col("title"))
    label = T.squeeze(F.translate(label, "[]()", "    "))
    item = F.concat(F.lit("- ["), label, F.lit("]("), "url", F.lit(")"))
    return top.groupBy(key).agg(F.concat(F.lit("\n\nSources:\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rn", item.alias("item")))), lambda r: r["item"]), "\n"))
        .alias("sources"))
