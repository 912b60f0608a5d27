"""The pipeline stage by stage against brute force on its own input."""

import random
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_contracts import SMALL, brute_ids, brute_lines, brute_repeats, check_packing, odd, rows_of  # noqa: F401

import corpus_pipeline
from recollect.llm import copies, packing
from recollect.llm.language import classify, encoders, is_held_out, learn

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("which", ["small", "odd"])
def test_stages(spark, tmp_path, odd, which):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet") if which == "small" else odd
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(path := f"{tmp_path}/{n}")
        out = spark.read.parquet(path)
        before, after = rows_of(docs), rows_of(out)
        assert name == "packing" or out.columns == columns
        texts = lambda rows: sorted(repr((r["doc_id"], r["text"])) for r in rows)
        if name == "language":
            models = encoders(learn(docs.where(~is_held_out())))
            found = [classify(r["text"], models) for r in before]
            assert texts(after) == texts(r for r, (lang, score) in zip(before, found) if lang != "und" and score >= 0.005)
            assert which == "odd" or len(after) > 0.97 * len(before)
        elif name == "line_dedup":
            assert texts(after) == texts({"doc_id": r["doc_id"], "text": r["kept_text"]} for r in brute_lines(before))
        elif name == "near_dedup":
            groups = brute_copies([r["text"] for r in before])
            members = defaultdict(list)
            for g, r in zip(groups, before):
                members[g].append(r["doc_id"])
            least = sorted((min((i for i in m if i is not None), default=None) for m in members.values()), key=repr)
            assert sorted((r["doc_id"] for r in after), key=repr) == least
            assert set(texts(after)) <= set(texts(before))
        elif name == "suffix_dedup":
            hashed = rows_of(docs.withColumn("hash", F.xxhash64("text")))
            want = sorted((repr(r["doc_id"]), r["n_bytes"] - r["n_removed"]) for r in brute_repeats(hashed, 100))
            cut = sorted((repr(r["doc_id"]), len(r["text"].encode())) for r in after)
            # A character that lost one of its bytes goes whole, so a text may be a little shorter.
            assert [i for i, _ in cut] == [i for i, _ in want]
            assert all(n - 3 * 40 <= m <= n for (_, n), (_, m) in zip(want, cut))
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        else:
            assert sum(r["length"] for r in after) == sum(map(len, brute_ids(r["text"] for r in before)))
            with_ids = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
            check_packing(rows_of(with_ids), before, 4096)
        docs = out


def brute_sets(text, width=5):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute_copies(all_texts, least=0.8):
    """The group of each text: what links of Jaccard similarity `least` or more connect."""
    sets = [brute_sets(t) for t in all_texts]
    first = {}
    root = [first.setdefault(s, i) for i, s in enumerate(sets)]
    ones = sorted(set(root))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ones):
        for j in ones[n + 1:]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in root]


def planted(n=120, seed=3):
    """Texts with exact copies, copies with a few words changed, and unlike texts with a shared passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    passage = [word() for _ in range(30)]
    out = []
    for i in range(n):
        base = [word() for _ in range(r.randint(3, 160))]
        out.append(base)
        for _ in range(r.randint(0, 3)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            out.append(copy)
        if i % 3 == 0:
            out.append(passage + [word() for _ in range(60)])
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_near_copies(spark, shard_rows):
    """Also where every shard is searched chunk against chunk."""
    texts = [None, "", " \n", "one", "one", "ONE", "two words", *planted()]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(4)
    got = sorted(r["doc_id"] for r in copies.keep_one_similar(docs, shard_rows=shard_rows).collect())
    assert got == sorted(set(brute_copies(texts)))


def test_near_copies_of_documents(spark):
    """All pairs at 0.8 or more at a larger size, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = rows_of(docs)
    got = sorted(r["doc_id"] for r in copies.keep_one_similar(docs).collect())
    groups = brute_copies([r["text"] for r in rows])
    assert got == sorted(rows[i]["doc_id"] for i in set(groups)) and len(got) < len(rows)


def test_few_copies(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert copies.keep_one_similar(empty).collect() == []
    one = spark.createDataFrame([(None, "a b"), (None, "a b"), (4, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, copies.keep_one_similar(one).collect()), key=repr) == [(2, ""), (None, "a b")]


def test_language_stage_keeps_own_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns(
        {"score": F.lit("mine"), "accepted": F.lit("no"), "lang_pred": F.col("doc_id"), "c0": F.lit(1)})
    out = corpus_pipeline.language(spark, docs, SMALL)
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert all((r["score"], r["accepted"], r["lang_pred"], r["c0"]) == ("mine", "no", r["doc_id"], 1) for r in out.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:1] == ["doc_id"] and out.agg(F.sum("length")).first()[0] > 0
