"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, halved and
then thinned with the distance; a container's points are discounted by its link
density. The best container is kept, with the siblings that read like it.
"""

import re
from html.parser import HTMLParser

import pyarrow as pa

from recollect.llm.common import in_parts

# Elements by role, and words in class, id and role that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button select textarea input option fieldset "
    "iframe object embed applet svg math canvas audio video map menu dialog datalist".split())
WRAPPERS = frozenset("form fieldset".split())  # may hold a whole page
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
PEERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table article section main div body html blockquote aside nav footer header form".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments "
    "commentlist complementary contentinfo cookie cookies consent copyright disqus dialog footer foot gdpr hidden "
    "masthead menu menubar modal nav navbar navigation newsletter notice notification outbrain overlay pager "
    "pagination popup popups promo promoted promotion recommend recommended recommendations related replies respond "
    "rss search share sharing shoutbox sidebar sidenav signup skip social sponsor sponsored sponsors subscribe "
    "subscription taboola tags toolbar topbar widget widgets alert warning disclaimer navlinks sitemap teaser".split())
REPLIES = frozenset("comment comments commentlist disqus replies respond".split())
REPLY_AREA = re.compile(r"(?:comments?|commentlist|disqus|replies|respond)(?:[-_]?(?:area|block|body|box|container|content|"
                        r"entry|form|item|list|post|section|text|thread|threads|wrapper|\d+))*")  # whole names of such parts
SOFT = frozenset("alert disclaimer recommend recommended recommendation recommendations related warning".split())  # may name article parts
NEAR = frozenset("p pre ul ol dl table blockquote figure section h2 h3 h4 h5 h6".split())  # may begin or end an article
LITTLE = 1 / 3  # of a page's paragraph text: a wrapper or a container with such a name that holds more stays
NEARLY_ALL = 0.9  # the same for replies, which often outweigh an article
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
UNFINISHED = re.compile(r"<[a-zA-Z/!][^<>]*\Z")
DEEPEST = 500  # as in browsers: elements nested deeper become children of this level
LEVELS = 12  # ancestors that a paragraph passes points to
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "points", "depth")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.items, self.points = tag, attrs, parent, [], 0.0
        self.depth = parent.depth + 1 if parent else 0

    def nodes(self):
        return [x for x in self.items if isinstance(x, Node)]


class Tree(HTMLParser):
    """A forgiving tree: open paragraphs and list items close where a new one begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)

    def _up_to(self, tags, fence):
        node = self.at
        while node is not self.root and node.tag not in fence:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag not in INLINE and tag != "br":
            peers = PEERS.get(tag)
            open_ = self._up_to(peers, FENCE) if peers else None if tag in VOID and tag != "hr" else \
                self._up_to(CLOSED_BY_BLOCK, FENCE)
            if open_ is not None:
                self.at = open_.parent
        node = Node(tag, dict(attrs), self.at)
        self.at.items.append(node)
        if tag not in VOID and node.depth < DEEPEST:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g", "rect", "circle", "use", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self._up_to({tag}, frozenset() if tag in FENCE else FENCE - {tag})
        if node is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.items.append(data)


def parse(html):
    tree = Tree()
    tree.feed(UNFINISHED.sub("", html))
    tree.close()
    return tree.root


def walk(root):
    """Nodes before their children, without recursion."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(reversed(node.nodes()))


def _names(attrs):
    text = " ".join(str(attrs.get(k) or "") for k in ("class", "id", "role"))
    return WORD.findall(CAMEL.sub(" ", text).lower()) if text.strip() else ()


def prune(root):
    """Take out what is never article text.

    Forms and containers named like furniture may be wrapped around an article, so they
    go by the share they hold of the paragraph text that the step before has left."""
    holds = {}  # an article's title or the main part lies below
    for node in reversed(list(walk(root))):
        holds[id(node)] = any(x.tag in ("main", "h1") or holds[id(x)] for x in node.nodes())
    _without(root, lambda x, inside: _never_text(x, inside))
    _without(root, lambda x, inside: not holds[id(x)] and _reply_area(x))
    for names, share in ((REPLIES, NEARLY_ALL), (FURNITURE - REPLIES, LITTLE)):
        own, sizes = _prose(root), _measure(root)
        most = share * own[id(root)]
        _without(root, lambda x, inside: own[id(x)] <= most and (
            names is not REPLIES and x.tag in WRAPPERS or not holds[id(x)] and _named(
                x, names - SOFT if inside and density(x, sizes) < 0.25 else names)))
    for node in [x for x in walk(root) if x.tag in WRAPPERS]:  # only their controls go
        _without(node, lambda x, inside: x.tag in ("label", "legend"))


def _without(root, gone):
    """Take out the nodes below root for which gone(node, inside an article) holds."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.items = [x for x in node.items if isinstance(x, str) or not gone(x, inside)]
        stack.extend((x, inside) for x in node.nodes())


def _prose(root):
    """Unlinked text in paragraphs below each node; of a page without any: all unlinked text."""
    sizes = _measure(root)
    own = {}
    for node in reversed(list(walk(root))):
        text, link = sizes[id(node)]
        own[id(node)] = text - link if node.tag in PARAGRAPHS else sum(own[id(x)] for x in node.nodes() if x.tag != "a")
    return own if own[id(root)] else {k: text - link for k, (text, link) in sizes.items()}


def _named(node, names):
    return node.tag not in ("body", "main") and bool(names.intersection(_names(node.attrs)))


def _reply_area(node):
    """Whether a name of the node is that of reader comments as a whole."""
    names = f"{node.attrs.get('class') or ''} {node.attrs.get('id') or ''}".lower().split()
    return node.tag not in ("body", "main") and any(REPLY_AREA.fullmatch(n) for n in names)


def _never_text(node, inside):
    if node.tag in DROPPED and node.tag not in WRAPPERS or node.tag == "header" and (not inside or _named(node, FURNITURE)):
        return True
    style = node.attrs.get("style")
    return "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or bool(style and HIDDEN.search(style))


def _measure(root):
    """Text length and linked text length below each node."""
    sizes = {}
    for node in reversed(list(walk(root))):
        text = sum(len(" ".join(x.split())) for x in node.items if isinstance(x, str))
        link = 0
        for x in node.nodes():
            a, b = sizes[id(x)]
            text, link = text + a, link + (a if x.tag == "a" else b)
        sizes[id(node)] = (text, link)
    return sizes


def _inline_text(node):
    """Text of a node and its inline descendants."""
    out, stack = [], list(reversed(node.items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag in INLINE:
            stack.extend(reversed(x.items))
    return "".join(out)


def score(root):
    """Points of every container; sizes of all nodes."""
    sizes = _measure(root)
    for node in walk(root):
        if node.tag in INLINE or node.parent is None and not node.items:
            continue
        text = " ".join(_inline_text(node).split())
        if node.tag not in PARAGRAPHS and (node.tag not in CONTAINERS or len(text) < 25):
            continue
        if not text:
            continue
        points = 1.0 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100.0, 3.0)
        up, level = (node, 0) if node.tag in CONTAINERS and node.tag not in PARAGRAPHS else (node.parent, 0)
        while up is not None and level < LEVELS:
            if up.tag not in INLINE and up.tag not in CLOSED_BY_BLOCK:
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = up.parent
    return sizes


def density(node, sizes):
    text, link = sizes[id(node)]
    return link / text if text else 0.0


def blocks(nodes):
    """Text blocks in page order: inline runs between block borders, white space as
    single spaces."""
    out, run = [], []

    def end():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack = [("node", n) for n in reversed(nodes)]
    while stack:
        kind, x = stack.pop()
        if kind == "end":
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag not in INLINE:
                end()
                stack.append(("end", None))
            stack.extend(("node", y) for y in reversed(x.items))
    end()
    return out


def main_nodes(root):
    """The best container and its siblings that belong to it."""
    prune(root)
    sizes = score(root)
    best, high = None, 0.0
    for node in walk(root):
        value = node.points * (1.0 - density(node, sizes))
        if value > high:
            best, high = node, value
    if best is None:
        return [root]  # no paragraph at all: what is left of the page
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    if up is not None:  # the article around the best container
        best, high = up, max(high, up.points)
    if best.parent is None:
        return [best]
    kept = []
    around = best.parent.items
    for i, x in enumerate(around):
        if isinstance(x, str):
            continue
        text, _ = sizes[id(x)]
        links = density(x, sizes)
        like = x.points * (1.0 - links) >= max(10.0, 0.2 * high) and x.tag in CONTAINERS
        prose = x.tag == "p" and (text > 80 and links < 0.25 or 0 < text <= 80 and links == 0)
        title = x.tag in ("h1", "h2", "h3") and not links
        if x is best or like or prose or title:
            kept.append(i)
    first, last = kept[0], kept[-1]
    if best.tag not in ("article", "main"):  # an article ends where its element does; else look outward

        def goes_on(x):
            return isinstance(x, str) and not x.strip() or not isinstance(x, str) and x.tag in NEAR and density(x, sizes) < 0.25

        while first > 0 and goes_on(around[first - 1]):
            first -= 1
        while last + 1 < len(around) and goes_on(around[last + 1]):
            last += 1
    # Between them, whatever is not mostly links: lists, tables, short sections, bare text.
    return [x for i, x in enumerate(around[first:last + 1], first)
            if i in kept or isinstance(x, str) or density(x, sizes) < 0.25]


def main_text(html):
    """The article of a page; null, empty or unreadable markup: the empty text."""
    if not html:
        return ""
    return "\n\n".join(blocks(main_nodes(parse(html))))


def extract_pages(pages):
    """`page_id`, `url`, `text`, `n_chars` per row of pages.

    Null or empty html and pages without any text give an empty text. Repeated rows get
    equal texts. Null ids and urls stay null. An empty table gives an empty table.
    """
    kinds = {n: pages.schema[n].dataType.simpleString() for n in ("page_id", "url")}

    def run(batches):
        for b in in_parts(batches):
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
