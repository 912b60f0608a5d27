"""Training-data pipeline over `documents`: language, lines, near copies, repeats, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
All but the last return the columns of docs.
"""

import public_tokenizers
from pyspark.sql import functions as F

from recollect.llm.common import stored, table
from recollect.llm.copies import keep_one_similar
from recollect.llm.language import identify, is_held_out
from recollect.llm.lines import dedup_lines
from recollect.llm.packing import pack
from recollect.llm.suffixes import remove_repeats


def _with_text(docs, out, text):
    """The rows of an operator's result as documents with the text it left."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def language(spark, docs, sf_dir):
    """Documents whose language is found; the others go.

    Null and empty texts, texts without a letter and those whose margin stays narrow are rejected;
    equal sizes of two languages reject too. Repeated rows fare alike. Without a single labelled
    document all go. Columns of docs may have any name, also those of the operator's results."""
    plain = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    found = identify(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in plain.items()]), docs.where(~is_held_out()))
    return found.where("accepted").select(*[F.col(n).alias(c) for c, n in plain.items()])


def line_dedup(spark, docs, sf_dir):
    """Lines that five or more documents hold stay in one of them, that of the largest doc_id.

    A null text becomes empty; a document that loses all its lines stays, with an empty text.
    Rows that repeat count as documents of their own; rows of the keeper's doc_id keep the line.
    `n_chars`, where docs have it, is counted anew; other columns stay as they are."""
    return _with_text(docs, dedup_lines(docs), F.col("kept_text"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): that
    of the smallest doc_id, null last.

    Null, empty and blank texts are copies of each other, so one of them stays; of equal rows one
    stays. All columns are kept, whatever their names."""
    return keep_one_similar(docs)


def suffix_dedup(spark, docs, sf_dir):
    """Repeated strings of 100 bytes stay where they first occur.

    A null text becomes empty; texts of fewer than 100 bytes stay. Rows with one doc_id and
    different texts are ordered by a hash of the text, equal rows are one document and get one
    answer. `n_chars`, where docs have it, is counted anew; other columns stay as they are."""
    return _with_text(docs, remove_repeats(docs, texts=True), F.col("kept_text"))


def packing(spark, docs, sf_dir):
    """Sequences of 4096 tokens, piece by piece.

    A null or empty text has the end id alone. Repeated rows are packed one by one, ties in a
    ranking go to the earlier document. Other columns than doc_id and text are not read."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("packing", packing)]
ORACLE_SQL = None  # SQL cannot state the tokenizer, the dictionaries or the fingerprints


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
