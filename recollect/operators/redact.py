"""Redaction jobs: word-list runs, the full scrub, secret counts, clipboard."""

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect import rules
from recollect.functions import privacy as R
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators.ordered import HOT_ROWS, Ordered

# A word list up to this size goes to every task as a set; a larger one is joined.
WORDLIST_MAX = 100_000
MORE_SPACE = re.compile("[\x1c-\x1f]")


def _shared(wordlist, max_set):
    """The words of a list as a set, or None where there are more than `max_set`."""
    words = wordlist.select("word").distinct().limit(max_set + 1).collect()  # bounded
    return frozenset(r["word"] for r in words) if len(words) <= max_set else None


def _is_word(tok, words):
    return tok.isascii() and tok.isalpha() and tok.lower() in words


def _tokens(line):
    """The words of a line; `str.split` knows four separators more than T.WS_CHARS."""
    return [t for t in re.split(f"[{T.WS_CHARS}]+", line) if t] if MORE_SPACE.search(line) else line.split()


def _runs_of(toks, words, min_run):
    """[(start, length)] of the runs of a line's tokens; each covers one of the places looked at."""
    out, i = [], min_run - 1
    while i < len(toks):
        if not _is_word(toks[i], words):
            i += min_run
            continue
        start, end = i, i + 1
        while start and _is_word(toks[start - 1], words):
            start -= 1
        while end < len(toks) and _is_word(toks[end], words):
            end += 1
        if end - start >= min_run:
            out.append((start, end - start))
        i = end + min_run
    return out


def _runs_with_set(lines, key, words, min_run):
    shared = lines.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("array<struct<start:int,length:bigint>>")
    def runs(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"start": a, "length": n} for a, n in _runs_of(_tokens(x), shared.value, min_run)])

    return lines.select(key, "line", F.explode(runs("_line")).alias("_run")).select(key, "line", "_run.*")


def seed_runs(docs, wordlist, key, text="text", min_run=rules.SEED_RUN_MIN_WORDS, max_set=WORDLIST_MAX):
    """R2 detection: (key, line, start, length) of every run of word-list words.

    Only lines that hold enough plain words in a row are taken apart, where they are read if the
    list has at most `max_set` words. Rows that share a key are one text and meet by a shuffle."""
    words = _shared(wordlist, max_set)
    if words is None:
        return _runs_with_join(_hinted(docs, key, text), wordlist, key, min_run)
    again = docs.groupBy(F.col(key).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    if again.isEmpty():
        return _runs_with_set(_hinted(docs, key, text), key, words, min_run)
    same = F.col(key).eqNullSafe(F.col("_again"))
    once, more = (_hinted(docs.join(again, same, how), key, text) for how in ("left_anti", "left_semi"))
    return _runs_with_set(once, key, words, min_run).unionByName(_runs_with_join(more, wordlist, key, min_run))


def _hinted(docs, key, text):
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line", "_line"))
    return lines.filter(F.col("_line").rlike(R.ASCII_WORD_RUN_HINT))


def _runs_with_join(lines, wordlist, key, min_run):
    toks = lines.select(key, "line", F.posexplode(T.words("_line")).alias("pos", "_tok"))
    plain = F.when(F.col("_tok").rlike(r"\A[A-Za-z]+\z"), F.lower("_tok"))
    hits = toks.withColumn("word", plain).filter(F.col("word").isNotNull()).join(
        wordlist.select("word").distinct(), "word", "left_semi")
    w = Window.partitionBy(key, "line").orderBy("pos")
    runs = hits.withColumn("_island", F.col("pos") - F.row_number().over(w))
    return (runs.groupBy(key, "line", "_island")
            .agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"))
            .filter(F.col("length") >= min_run).drop("_island"))


def _scrub_line(line, words):
    toks = _tokens(line)
    runs = _runs_of(toks, words, rules.SEED_RUN_MIN_WORDS)
    for start, n in reversed(runs):
        toks[start:start + n] = [rules.SEED_MARK]
    return " ".join(toks) if runs else line


def _scrub_with_set(docs, words, text):
    shared = docs.sparkSession.sparkContext.broadcast(words)

    # Rows go to Python a hundred at a time, so that no task holds more whole texts.
    @F.udf("string", useArrow=False)
    def scrub(x):
        return None if x is None else "\n".join(_scrub_line(l, shared.value) for l in x.split("\n"))

    # Most texts hold no long run of plain words and are not sent there.
    return docs.withColumn(text, F.coalesce(scrub(F.when(F.col(text).rlike(R.ASCII_WORD_RUN_HINT), F.col(text))), F.col(text)))


def _scrub_with_join(docs, wordlist, key, text):
    runs = _runs_with_join(_hinted(docs, key, text), wordlist, key, rules.SEED_RUN_MIN_WORDS).groupBy(key).agg(
        F.collect_list(F.struct("line", "start", "length")).alias("_runs"))  # within one text

    def redo(line, i):
        mine = F.filter("_runs", lambda r: r["line"] == i)

        def word(w, j):
            return (F.when(F.exists(mine, lambda r: r["start"] == j), F.lit(rules.SEED_MARK))
                    .when(~F.exists(mine, lambda r: (j > r["start"]) & (j < r["start"] + r["length"])), w))

        joined = F.array_join(F.array_compact(F.transform(T.words(line), word)), " ")
        return F.when(F.size(mine) == 0, line).otherwise(joined)

    scrubbed = F.array_join(F.transform(F.split(text, "\n"), redo), "\n")
    return (docs.join(runs, key, "left").withColumn(
        text, F.when(F.col("_runs").isNull(), F.col(text)).otherwise(scrubbed)).drop("_runs"))


def scrub_seed_phrases(docs, wordlist, key, text="text", max_set=WORDLIST_MAX):
    """R2: replace runs of 12 or more word-list words in a line by a mark."""
    words = _shared(wordlist, max_set)
    if words is not None:
        return _scrub_with_set(docs, words, text)
    if docs.isStreaming:
        raise ValueError(f"a stream takes a list of at most {max_set} words")
    return _scrub_with_join(docs, wordlist, key, text)


def scrub(docs, wordlist, key, text="text"):
    """Word-list runs, then tokens, then cards."""
    return scrub_with(docs, wordlist, key, text)


def contains_secret(docs, wordlist, key, text="text"):
    """The rows with a flag; the text is scrubbed once."""
    out = scrub_with(docs.withColumn("_clean", F.col(text)), wordlist, key, "_clean")
    return out.withColumn("secret", F.col("_clean") != F.col(text)).drop("_clean")


def secret_summary(docs, wordlist, key, by):
    """Texts and secrets of each kind per group."""
    runs = seed_runs(docs, wordlist, key).groupBy(key).agg(F.count(F.lit(1)).alias("seeds"))
    counted = docs.select(key, *by, R.count_tokens("text").alias("keys"),
                          R.count_cards("text").alias("cards"))
    return (counted.join(runs, key, "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.coalesce("seeds", F.lit(0))).alias("seeds"),
        F.sum("keys").alias("keys"), F.sum("cards").alias("cards"),
        F.count_if((F.coalesce("seeds", F.lit(0)) > 0) | (F.col("keys") > 0) | (F.col("cards") > 0))
        .alias("texts_with_secret")))


def scrub_with(docs, wordlist, key, text="text"):
    """Seed phrases, tokens and cards. A caller without a list of seed words says so
    with an empty one."""
    docs = scrub_seed_phrases(docs, wordlist, key, text)
    return docs.withColumn(text, R.scrub_tokens(text)).withColumn(text, R.scrub_cards(text))


def clipboard_filter(clips, wordlist, limit=HOT_ROWS):
    """Trimmed clipboard texts of useful length, consecutive repeats dropped,
    items with a secret dropped whole.  The repeat check sees secret items too."""
    rows = clips.withColumn("text", T.trim_ws("text")).filter(
        F.octet_length("text") >= rules.CLIPBOARD_MIN_BYTES)
    o = Ordered(rows, ["stream"], ["time_start", "seq"], C.micros("time_start"), limit)
    o.previous(["text"], "_prev")
    fresh = o.result().filter(F.col("_prev").isNull() | (F.col("_prev.text") != F.col("text")))
    checked = scrub_with(fresh.drop("_prev").withColumn("_clean", F.col("text")), wordlist, "seq", "_clean")
    return checked.filter(F.col("_clean") == F.col("text")).drop("_clean")


def log_tail_redacted(lines, n, wordlist):
    """The last n log lines (by `seq`), content tails cut, then scrubbed."""
    tail = lines.orderBy(F.col("seq").desc()).limit(n).withColumn("line", R.redact_log_line("line"))
    return scrub_with(tail, wordlist, "seq", "line")
