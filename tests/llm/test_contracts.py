"""The dealt operators against brute force, at the smallest scale and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm import html, lines, packing, pieces, quality, sharding, simhash, suffixes, topk
from recollect.llm.bktree import BKTree
from recollect.llm.components import components
from recollect.llm.language import identify, is_held_out
from recollect.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, key int, spans int, at int, "
          "lines string, h1 int, lead int, n int, part string, text_hash string, score string, value string")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return rows_of(spark.read.parquet(f"{SMALL}/documents.parquet"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß漢😀") for _ in range(r.randint(1, 9))) for _ in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = "  THE shared line number one, which many documents hold \t"
    passage = say(60)
    texts = [None, "", "\n", " \t\r\n ", "x", say(5), shared, shared.strip().lower(), f"{say(9)}\n{shared}\n{shared}\n{say(4)}",
             f"{say(3)}\n{shared}", f"{shared}\n", f"{passage} {say(20)}", f"{say(7)} {passage}", say(40) + passage + say(3) + passage,
             say(30_000), "a" * 5000, "ab" * 700, "\x00<|endoftext|> </s> <s> ▁▁ x  y   z　q", "12345 'tis it's",
             "漢" * 90, "😀" * 70, "\n".join([shared] * 30)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], None, "r", i, 1, 2, "l", 3, 4, 5, "p", "h", "s", "v")
            for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], rows[11], (8, "another text under a used id\n" + shared, *rows[8][2:]), (None, shared, *rows[8][2:]),
             (None, None, *[None] * 15), (None, shared, *rows[8][2:])]
    return spark.createDataFrame(rows, SCHEMA).cache()


def sha(data):
    return hashlib.sha256(data).hexdigest()


def same(got, want, *columns):
    key = lambda rows: sorted(repr(tuple(r[c] for c in columns)) for r in rows)
    assert key(got) == key(want)


# 1 line dedup

def brute_lines(docs):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    held, keeper = Counter(), {}
    for d in docs:
        for k in {key(x) for x in (d["text"] or "").split("\n")}:
            if len(k) >= 40:
                held[k] += 1
                keeper[k] = max((x for x in (keeper.get(k), d["doc_id"]) if x is not None), default=None)
    for d in docs:
        ls = (d["text"] or "").split("\n")
        stay = [x for x in ls if not (held[key(x)] >= 5 and keeper[key(x)] != d["doc_id"])]
        yield {"doc_id": d["doc_id"], "n_lines": len(ls), "n_dropped": len(ls) - len(stay), "kept_text": "\n".join(stay)}


def test_line_dedup(spark, docs, odd):
    for rows, df in ((docs, spark.read.parquet(f"{SMALL}/documents.parquet")), (rows_of(odd), odd)):
        got = rows_of(lines.dedup_lines(df).select("row.doc_id", "n_lines", "n_dropped", "kept_text"))
        same(got, brute_lines(rows), "doc_id", "n_lines", "n_dropped", "kept_text")
    assert sum(r["n_dropped"] for r in got) > 0
    assert lines.dedup_lines(odd).schema["row"].dataType == odd.schema


# 2 packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute_ids(texts):
    t = TOKENIZER
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check_packing(got, docs, window):
    want = Counter((d["doc_id"], tuple(ids)) for d, ids in zip(docs, brute_ids(d["text"] for d in docs)))
    sequences, begun = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        begun[r["doc_id"], r["doc_tokens"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == len(r["ids"]) > 0
    for rows in sequences.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0] + [r["length"] for r in rows])[:-1].tolist()
        total = sum(r["length"] for r in rows)
        assert total <= window and total & (total - 1) == 0  # no padding at all
    for (doc, n), rows in begun.items():  # the pieces hold the documents' ids, each once
        own = [ids for (d, ids), c in want.items() for _ in range(c) if d == doc and len(ids) == n]
        left = Counter(t for ids in own for t in enumerate(ids))
        for r in rows:
            left.subtract((r["start"] + i, t) for i, t in enumerate(r["ids"]))
        assert not any(left.values())
        want = Counter({k: c for k, c in want.items() if not (k[0] == doc and len(k[1]) == n)})
    assert not want


def test_packing(spark, docs, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    for rows, df in ((docs, spark.read.parquet(f"{SMALL}/documents.parquet")), (rows_of(odd), odd)):
        got = packing.pack(df, path, window=512, shard_tokens=30_000, block_tokens=20_000, with_ids=True)
        check_packing(rows_of(got), rows, 512)


def test_ids_of_random_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, r = packing.Coder(path), random.Random(1)
    for _ in range(3000):
        alphabet = r.choice(["aB.,'s t", "é\u0301ÀŒß ΣσςΟΔ. x", "<|endoftext|> a", "12 a.1,b;!?x", "don't I'll we've x.y,,z!! ",
                             "漢字か。な 😀!a ", "  \u3000x y\x85z.\x1c\x1dq", "İıǅ ﬁ.Ǻ,\u0301 क़.", "a$%# é&*(x)[ß]<=> "])
        text = "".join(r.choice([*alphabet, "<|endoftext|>", "<|EndOfText|>"]) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(coder.text(text, b"\2\0"), "<u2").tolist() == brute_ids([text])[0], repr(text)


def test_packing_prefers_neighbours():
    """BM25 by hand: a window takes the document that shares the seed's words."""
    docs = [np.array(x, "<u2") for x in ([5, 6, 7], [9, 10, 11], [5, 6, 8], [12, 13, 14])]
    idf = np.ones(packing.VOCABULARY)
    assert [p[0] for p in packing.pack_block(docs, idf, 3.0, 6)[0]] == [0, 2]


def test_bm25_scores():
    """Common ids (the matrix) and rare ones (postings) add up to BM25 by definition."""
    r = np.random.default_rng(3)
    docs = [np.concatenate((r.integers(0, 40, n), r.integers(0, 5000, n // 2 + 1))).astype("<u2") for n in r.integers(0, 60, 50)]
    idf, mean = r.random(packing.VOCABULARY), 50.0
    for dense in (packing.DENSE, 300):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(packing, "DENSE", dense)
            index = packing.Index(docs, idf, mean)
        for seed in (0, 7, 49):
            want = [sum(idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, c in Counter(d.tolist()).items()
                        if t in set(docs[seed].tolist())) for d in docs]
            assert np.allclose(index.scores(seed), want)


def test_ranking_takes_ties_in_order():
    r = np.random.default_rng(4)
    for n in (0, 5, 64, 65, 500):
        scores = r.integers(0, 9, 700).astype(float)
        left = np.sort(r.choice(700, n, replace=False))
        assert list(packing.ranked(scores, left)) == left[np.argsort(-scores[left], kind="stable")].tolist()


def test_signatures_and_distinct_ids():
    def one(ids):
        x = ids.astype(np.uint64)
        if len(x) >= 3:
            x = x[:-2] * np.uint64(65536 ** 2) + x[1:-1] * np.uint64(65536) + x[2:]
        x = (x ^ (x >> np.uint64(31))) * packing.NO_PAST
        return int((x ^ (x >> np.uint64(29))).min() >> np.uint64(1))

    r, seen = np.random.default_rng(1), np.zeros(packing.VOCABULARY, np.int64)
    docs = [r.integers(0, 60, int(n)).astype(np.uint16) for n in (1, 2, 3, 4, 100, 1, 2, 7, 1)]
    for some in (docs, docs[:1], docs[1:2], docs[2:3], docs[5:7]):
        assert packing.signatures(some).tolist() == [one(d) for d in some]
    assert all(sorted(packing.distinct(d, seen).tolist()) == sorted(set(d.tolist())) for d in docs)


# 3 sharding

def brute_ring(keys, shards, replicas):
    at = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    ring = sorted((at(f"shard-{i}"), i % shards) for i in range(shards * replicas))
    arcs = defaultdict(list)
    for k in keys:
        p = at("" if k[0] is None else str(k[0]))
        arcs[next((i for i, (x, _) in enumerate(ring) if x >= p), 0)].append((p, k))
    even, more = divmod(len(keys), shards)
    room, out = [even + (s < more) for s in range(shards)], []
    order = lambda x: (x[0], *[(v is not None, v or 0) for v in x[1]])
    for a in range(len(ring)):
        for p, k in sorted(arcs[a], key=order):
            j = a
            while not room[ring[j % len(ring)][1]]:
                j += 1
            room[ring[j % len(ring)][1]] -= 1
            out.append((k, ring[j % len(ring)][1]))
    return out


def test_sharding(spark, odd):
    base = odd.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"),
                      F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lead", "n", "part")
    many = spark.range(700).selectExpr("id doc_id", "id size", "id text_crc32")
    for df, shards in ((base, 5), (many, 24), (many.limit(0), 24), (base.limit(3), 24)):
        got = rows_of(sharding.assign(df, shards, replicas=8, part_rows=16))
        keys = [(r["doc_id"], r["size"], r["text_crc32"]) for r in rows_of(df)]
        assert sorted(map(repr, (((r["doc_id"], r["size"], r["text_crc32"]), r["shard"]) for r in got))) == \
            sorted(map(repr, brute_ring(keys, shards, 8)))
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


# 4 suffix dedup

def brute_repeats(docs, width):
    order = lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["hash"])
    once = {(d["doc_id"], d["text"] or ""): d for d in docs}
    seen, out = set(), {}
    for d in sorted(once.values(), key=order):
        data = (d["text"] or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - width + 1):
            w = data[s:s + width]
            if w in seen:
                gone[s:s + width] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[d["doc_id"], d["text"] or ""] = (len(data), int(gone.sum()), spans, sha(kept))
    for d in docs:
        yield dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), (d["doc_id"], *out[d["doc_id"], d["text"] or ""])))


@pytest.mark.parametrize("width, gram, buckets", [(100, 50, 400_000), (20, 8, 700), (20, 8, 60)])
def test_suffix_dedup(spark, docs, odd, monkeypatch, width, gram, buckets):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (100, 50, buckets))
    monkeypatch.setattr(suffixes.anchors, "SEGMENT", 4000 if width == 20 else 1 << 18)
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 120"), odd):
        rows = rows_of(df.withColumn("hash", F.xxhash64("text")))
        got = rows_of(suffixes.remove_repeats(df, width, gram))
        same(got, brute_repeats(rows, width), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_texts(odd):
    got = suffixes.remove_repeats(odd, texts=True)
    assert got.schema["row"].dataType == odd.schema
    assert all("�" not in r["kept_text"] for r in rows_of(got))


# 5 quality rules

def brute_measures(text):
    text = text or ""
    words = [w for w in re.split(f"[{BLANK}]+", text) if w]
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    ls = [x for x in text.split("\n") if x.strip(BLANK)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(hit)


def test_quality(spark, docs, odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for rows, df in ((docs, spark.read.parquet(f"{SMALL}/documents.parquet")), (rows_of(odd), odd)):
        got = rows_of(quality.filter_quality(df))
        want = []
        for d in rows:
            m = brute_measures(d["text"])
            want.append({"doc_id": d["doc_id"], **dict(zip(names, m)), "base_failed": m[0] < 10 or 100 * m[4] > 20 * m[0]})
        same(got, want, "doc_id", *names, "base_failed")
        assert all(r["kept"] == (not r["base_failed"] and not r["failed_rules"]) for r in got)


def test_quality_sketch(spark):
    """Quantiles of the sketch are within 1/64 of the exact ones."""
    df = spark.range(5000).selectExpr("'en' lang", "'s' source", "id * id word_length", "id symbols", "id dup_lines", "id repeats")
    got = quality.thresholds(quality.sketches(df), 0, 1).where("level = 0").first()
    for rule, exact in (("word_length", lambda q: (q - 1) ** 2), ("symbols", lambda q: q - 1)):
        low, high = exact(1250), exact(3750)
        assert low * 63 / 64 <= got[rule]["low"] <= low and high * 63 / 64 <= got[rule]["high"] <= high


# 6 extraction

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><p>Site name, here</p></header>
<nav><ul><li><a href=a>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, and more cookies, on this site.</p></div>
<div id=wrap><article><header><h1>The &amp; title</h1></header><p>First   paragraph, with <a href=x>a link</a> and &eacute;.
<p>Second one,<br>broken.<ul><li>Item <b>one</b></li><li>Item two</li></ul><blockquote>Quoted, text.</blockquote>
<form><input><p>Sign up, now.</p></form><script>var x = "<p>no</p>";</script><table><tr><td>Cell</td></tr></table>
<p>Last, paragraph.</p><div class="share">Share this</div></article>
<section class="comments"><article class="comment"><p>Nice, article, I like it, very much.</p></article></section></div>
<aside><p>Also, read, this, and, that.</p></aside><footer><p>Contact, imprint.</p></footer></body></html>"""


def test_extraction(spark):
    want = ["The & title", "First paragraph, with a link and é.", "Second one, broken.", "Item one", "Item two", "Quoted, text.",
            "Cell", "Last, paragraph."]
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html.main_text(PAGE).split("\n\n") == want
    assert html.main_text(plain.replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")).split("\n\n") == want
    rows = [(1, "u", None), (None, None, ""), (2, "u", "<p>only</p>"), (2, "u", "<p>only</p>"), (3, "u", "<div><div"), (4, "u", "bare text"),
            (5, "u", "<p>" * 3000 + "deep"), (6, "u", "<div>" * 3000 + "deep")]
    got = rows_of(html.extract_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")))
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [
        (1, "", 0), (None, "", 0), (2, "only", 4), (2, "only", 4), (3, "", 0), (4, "bare text", 9), (5, "deep", 4), (6, "deep", 4)]


def test_extraction_of_pages(spark):
    for r in rows_of(spark.read.parquet(f"{SMALL}/pages.parquet")):
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(x.split()) for x in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        want = [re.sub(r"<[^>]*>", "", x).strip() for x in blocks]
        import html as codec
        assert html.main_text(r["html"]).split("\n\n") == [" ".join(codec.unescape(x).split()) for x in want if x]


# 7 near-dedup

def brute_fingerprint(text):
    words = [w for w in re.split(f"[{BLANK}]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def test_near_groups(spark, docs, odd):
    for rows, df in ((docs, spark.read.parquet(f"{SMALL}/documents.parquet")), (rows_of(odd), odd)):
        fps = [brute_fingerprint(d["text"]) for d in rows]
        group = brute_groups(fps, 3)
        least = defaultdict(list)
        for d, f in zip(rows, fps):
            least[group[f]] += [] if d["doc_id"] is None else [d["doc_id"]]
        want = [{"doc_id": d["doc_id"], "fp": f, "component_id": min(least[group[f]], default=None)} for d, f in zip(rows, fps)]
        got = rows_of(simhash.near_groups(df))
        for r in got:
            r["fp"] &= (1 << 64) - 1
        same(got, want, "doc_id", "fp", "component_id")


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_near_links(spark, shard_rows):
    """Families of close fingerprints; small shards are searched chunk by chunk."""
    r = random.Random(3)
    fps = [0, (1 << 64) - 1]
    for _ in range(30):
        f = r.getrandbits(64)
        for _ in range(8):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
            fps.append(f)
    signed = [[f - (1 << 64) if f >> 63 else f] for f in set(fps)]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 3, shard_rows)
    stars = {r["a"]: r["b"] for r in components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for (f,) in signed:
        got[stars.get(f, f)].add(f & (1 << 64) - 1)
    for f, g in brute_groups(fps, 3).items():
        want[g].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_bk_tree():
    r = np.random.default_rng(1)
    items = (r.integers(0, 1 << 16, 300) | (r.integers(0, 4, 300) << 40)).astype(np.uint64)
    for queries in (items, items[:0], items[:5]):
        got = {tuple(x) for x in BKTree(items).within(queries, 3, block=64).tolist()}
        assert got == {(i, j) for i, q in enumerate(queries.tolist()) for j, x in enumerate(items.tolist()) if (q ^ x).bit_count() <= 3}
    assert len(BKTree([]).within(items, 3)) == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (200, 90)]
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 200: 90}


# 8 top-k

def brute_top(vectors, k, every):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    seen = set()
    for i, q in good:
        if i % every or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        hits = sorted((-clip(sum(a * b for a, b in zip(q, v))), j) for j, v in good if j != i)[:k]
        for rank, (s, j) in enumerate(hits, 1):
            yield {"query_id": i, "rank": rank, "vec_id": j, "score": -s}


def test_top_k(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in rows_of(spark.read.parquet(f"{SMALL}/embeddings.parquet"))]
    odd = [(0, [0.5, -0.25, 1.0]), (0, [0.5, -0.25, 1.0]), (1, [1.0, 1.0]), (2, []), (3, None), (4, [None, 1.0]), (None, [1.0]),
           (5, [float("nan")]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0, 0.0]), (100, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0])]
    huge = [(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 1.0])]
    for vectors, k, every, block in ((rows, 10, 100, 1024), (rows, 3, 7, 20), (odd, 4, 100, 1), (odd, 10, 1, 3), (huge, 10, 2, 9), ([], 10, 100, 9)):
        df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string").repartition(3)
        exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
        same(rows_of(topk.top_k(df, k, every, block=block)), brute_top(exact, k, every), "query_id", "rank", "vec_id", "score")


# 9 SentencePiece

def test_pieces(spark, docs, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for rows, df in ((docs, spark.read.parquet(f"{SMALL}/documents.parquet")), (rows_of(odd), odd)):
        want = []
        for d in rows:
            ids = model.encode(d["text"] or "", add_bos=True, add_eos=True)
            want.append({"doc_id": d["doc_id"], "n_tokens": len(ids), "ids": ids, "decoded": model.decode(ids),
                         "ids_sha256": sha(np.array(ids, "<u4").tobytes()), "decoded_sha256": sha(model.decode(ids).encode())})
        same(rows_of(pieces.encode_docs(df, path, texts=True)), want, "doc_id", "n_tokens", "ids", "decoded")
        same(rows_of(pieces.encode_docs(df, path)), want, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_pieces_on_random_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, coder = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCoder(path)
    r = random.Random(11)
    for _ in range(3000):
        alphabet = r.choice(["ab", "the rin", "aeiourstln ", " \n\t▁x", "0123456789.,", "ÄÖüßéèçñ 漢字かな😀", "  e", "(){}[]<>=;\n  if"])
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        ids = model.encode(text, add_bos=True, add_eos=True)
        assert coder.encode(text).tolist() == ids and coder.decode(ids) == model.decode(ids), repr(text)


# 10 language

def test_language(spark, odd):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = rows_of(identify(df.select("doc_id", "text", F.col("lang").alias("truth")), df.where(~is_held_out())).withColumn("held", is_held_out()))
    held = [r for r in got if r["held"]]
    assert len(held) > 250 and sum(r["lang_pred"] == r["truth"] for r in held) >= 0.98 * len(held)
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    out = identify(odd, odd)
    assert [c for c in out.columns if c not in ("lang_pred", "score", "accepted")] == [c for c in odd.columns if c != "score"]
    for r in rows_of(out):
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1
        assert r["lang_pred"] in ("en", "de", "und") and (r["accepted"] or r["lang_pred"] == "und" or r["score"] < 0.005)
    assert {r["lang_pred"] for r in rows_of(identify(df.select("doc_id", "text"), df.limit(0)))} == {"und"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "pages", "embeddings"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
