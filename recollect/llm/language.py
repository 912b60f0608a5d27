"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of samples of its texts. A
text is encoded in blocks with every dictionary, and the language with the smallest
total wins. The margin over the second is the score's source; a narrow margin rejects.
Sizes are whole bytes, too coarse for short or repetitive texts. Languages whose sizes
lie that close are therefore measured again: by how much the text lengthens the code of
each of some 30 slices of a dictionary, with the letter codes of that slice, on average.
Letters are lower-cased for the dictionaries and the texts.

Bounded sample (the only part that does not read all rows): `slots` documents for each
language, one from each hash slot, each giving at most `excerpt` bytes from its
middle; at most `max_languages` languages, the most frequent ones. Predictions read
whole texts.
"""

import re
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from recollect.llm.common import in_parts, utf8

LETTER = re.compile(r"[A-Za-z]")  # the common case; other letters are asked one by one
BLOCK = 4096
LEVEL = 6
SLICE = 2048  # bytes of a dictionary that a close text is measured behind
NARROW = 0.005


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs, slots=128, excerpt=512, max_languages=200):
    """{language: dictionary bytes} from the rows of docs with a language and a text,
    the most frequent language first.

    The result is bounded: languages * slots * excerpt bytes (64 KB a language).
    """
    known = docs.where("lang is not null and text is not null and text <> ''").select("doc_id", "lang", "text")
    langs = [r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()]
    order = F.struct(F.xxhash64("doc_id", F.lit("order")).alias("h"), "doc_id")
    picks = known.where(F.col("lang").isin(langs)).groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).alias("slot")).agg(
        F.min(order)["doc_id"].alias("doc_id")).where("doc_id is not null").select("lang", "doc_id")
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - excerpt) / 2).cast("int")), F.lit(excerpt))
    rows = known.join(F.broadcast(picks), ["lang", "doc_id"]).select("lang", "doc_id", middle.alias("part")).distinct().collect()
    parts = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["part"])):
        parts[r["lang"]].append(utf8(r["part"].lower())[:excerpt])
    return {lang: b"\n".join(parts[lang][:slots]) for lang in langs if lang in parts}


def encoders(dictionaries):
    """Per language: its name, the encoder with its dictionary, and its slices with the
    sizes of their codes."""
    out = []
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    for lang, data in dictionaries.items():
        content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=LEVEL)
        slices = [data[i:i + SLICE] for i in range(0, max(1, len(data) - SLICE // 2), SLICE)]
        out.append((lang, zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_dict_id=False),
                    [(x, len(plain.compress(x))) for x in slices]))
    return out


def lengthening(blocks, slices):
    """Bytes that the blocks add to the code of a slice, on average."""
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    return sum(len(plain.compress(x + b"\n" + b)) - size for b in blocks for x, size in slices) / len(slices)


def has_letter(text):
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


def classify(text, models, narrow=NARROW):
    """Language, score (0 to 1: how much shorter the best code is than the second)."""
    if not models or text is None or not has_letter(text):
        return "und", 0.0
    data = utf8(text.lower())
    blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = sorted(((sum(len(m.compress(b)) for b in blocks), lang, slices) for lang, m, slices in models), key=lambda x: x[0])
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    close = [x for x in sizes if 1.0 - sizes[0][0] / x[0] < narrow]
    if len(close) > 1:
        sizes = sorted(((lengthening(blocks, slices), lang, slices) for _, lang, slices in close), key=lambda x: x[0])
    best, second = max(sizes[0][0], 0.0), max(sizes[1][0], 0.0)
    return sizes[0][1], 1.0 - best / second if second else 0.0


def identify(docs, train, min_margin=0.005, **sample):
    """Adds `lang_pred`, `score`, `accepted` to all columns of docs (replacing columns
    of these names). train: the labelled rows to learn from.

    Null text or a text without letters: `und`, score 0, not accepted. No labelled row
    at all: `und` everywhere. Equal sizes: the more frequent language, score 0. One
    learned language: that, score 1. A margin below `min_margin` is measured once more on
    the slices, and that margin is the score. Repeated rows get equal answers.
    """
    dictionaries = learn(train, **sample)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "accepted")]
    at = [f.name for f in keep].index("text")
    names = [f.name for f in keep] + ["lang_pred", "score"]

    def run(batches):
        models = encoders(dictionaries)
        for b in in_parts(batches):
            found = [classify(t, models, min_margin) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=names)

    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string", "score double"])
    out = docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, columns)
    return out.withColumn("accepted", (F.col("lang_pred") != "und") & (F.col("score") >= min_margin))
