"""Document fingerprints (12): the homomorphic hash, the edited texts, and their likeness."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contracts import SMALL, odd, rows_of  # noqa: F401

from recollect.llm import multiset as M
from recollect.llm.queries import QUERIES


def one(text):
    return M.write(*M.sums([text]))[0]


def test_order_does_not_matter():
    lines = ["a first paragraph of some length", "second", "", "the third one, longer than sixteen bytes", "second"]
    assert one("\n".join(lines)) == one("\n".join(reversed(lines))) != one("\n".join(lines[:-1]))
    assert len({one(t) for t in ("", "\n", "a", "A", " a", "a\n", "a\na", "漢", "b a")}) == 9


def test_sums_are_homomorphic():
    parts = ["one paragraph that is long enough", "ab", "", "漢字 😀 and more text here", "x" * 5000]
    exact, near = M.sums(parts)
    with np.errstate(over="ignore"):
        assert M.write(exact.sum(0, dtype=np.uint64)[None], near.sum(0)[None])[0] == one("\n".join(parts))
    back = M.read([one(t) for t in parts])
    assert (back[0] == exact).all() and (back[1] == M.signed(near)).all()


def test_blocks_agree_with_brute_force(monkeypatch):
    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("abé漢 \n"), size=int(n))) for n in (0, 3, 15, 16, 17, 90, 3000)] + ["", "\n\n", "z" * 40]

    def brute(text):
        near = np.zeros(M.LANES, np.int64)
        for p in text.encode().split(b"\n"):
            if 0 < len(p) < M.GRAM:
                h = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little")]
            else:
                h = [int(M._grams(np.frombuffer(p[i:i + M.GRAM], np.uint8))[0]) for i in range(len(p) - M.GRAM + 1) if p]
            for v in h:
                near[v % M.LANES] += 1 - 2 * ((v >> 40) & 1)
        return near

    want = np.array([brute(t) for t in texts])
    for block in (1 << 18, 1, 7, 64):
        monkeypatch.setattr(M, "BLOCK", block)
        assert (M.sums(texts)[1] == want).all()


def check(got, docs, sized=True):
    """docs in descending order: the rows of `got`, in any order."""
    texts = [d["text"] or "" for d in docs]
    prints = dict(zip(texts, M.write(*M.sums(texts))))
    lanes = lambda t: M.read([one(t)])[1]
    want = []
    for i, d in enumerate(docs):
        after = texts[(i + 1) % len(texts)]
        half = len(texts[i]) // 2
        new = texts[i][:len(texts[i]) - half] + after[:half]
        want.append((d["doc_id"], len(texts[i]), hashlib.sha256(new.encode()).hexdigest(), prints[texts[i]], one(new),
                     float(M.likeness(lanes(texts[i]), lanes(new))[0]), float(M.likeness(lanes(texts[i]), lanes(after))[0])))
    rows = [tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
            for r in got]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def ordered(spark, docs):
    rows = rows_of(docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))))
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]), reverse=True)


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = rows_of(QUERIES["op12_fingerprints"](spark, SMALL))
    check(out, ordered(spark, docs))
    long = [r for r in out if r["n_chars"] >= 200]
    assert all(0 <= r[c] <= 1 for r in out for c in ("near_edited", "near_next"))
    assert sum(r["near_edited"] > r["near_next"] + 0.2 for r in long) > 0.95 * len(long)


def test_odd_rows(spark, odd):  # noqa: F811
    check(rows_of(M.edited_fingerprints(odd)), ordered(spark, odd))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "just one text here")], [(None, "a"), (None, "b"), (2, None)],
                                  [(7, "the very same row of text")] * 500 + [(3, "other"), (9, "last")]])
def test_few_and_repeated_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = rows_of(M.edited_fingerprints(docs))
    assert len(out) == len(rows)
    if rows:
        check(out, ordered(spark, docs))


@pytest.mark.parametrize("kind", ["string", "decimal(9,2)", "smallint"])
def test_other_ids(spark, kind):
    docs = spark.createDataFrame([(str(i), f"text number {i} of some length") for i in range(90)], "doc_id string, text string")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast(kind))
    rows = sorted(rows_of(docs), key=lambda r: r["doc_id"], reverse=True)
    check(rows_of(M.edited_fingerprints(docs)), rows)


def test_repeated_rows_are_dealt_to_several_ranges(spark):
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, 5, id) AS doc_id", "if(id % 2 = 0, 'same', string(id)) AS text")
    out = M.edited_fingerprints(docs)
    sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) > 1 and max(sizes) < 2200 and sum(sizes) == 4000


def test_update(spark):
    first = spark.createDataFrame([(1, "a line\nb line, which is somewhat longer"), (2, None), (3, "stays"), (None, "n")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, "a line", -1), (1, "a new paragraph, longer than sixteen", 1), (1, "twice", 1), (1, "twice", 1),
                                   (2, "two", 1), (2, "", -1), (8, "unknown", 1), (None, "m", 1), (3, None, 1), (3, "x", None)],
                                  "doc_id long, paragraph string, change int")
    got = {r["doc_id"]: r["fingerprint"] for r in M.update(M.fingerprints(first), edits).collect()}
    assert got == {1: one("twice\nb line, which is somewhat longer\na new paragraph, longer than sixteen\ntwice"), 2: one("two"),
                   3: one("stays"), None: one("m\nn")}
    back = M.update(M.fingerprints(first), edits.unionByName(edits.withColumn("change", -F.col("change"))))
    assert {r["doc_id"]: r["fingerprint"] for r in back.collect()} == {r["doc_id"]: r["fingerprint"] for r in M.fingerprints(first).collect()}


def test_update_of_a_hot_document(spark):
    table = M.fingerprints(spark.createDataFrame([(1, "start")], "doc_id long, text string"))
    edits = spark.range(20_000).selectExpr("1L AS doc_id", "concat('paragraph number ', id % 50) AS paragraph", "1 AS change").repartition(8)
    want = one("\n".join(["start"] + [f"paragraph number {i % 50}" for i in range(20_000)]))
    assert M.update(table, edits).first()["fingerprint"] == want
