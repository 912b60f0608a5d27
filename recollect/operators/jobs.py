"""Table jobs made of the text and rule functions (Q1-Q8)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import classify as K
from recollect.functions import numbers as N
from recollect.functions import payload as J
from recollect.functions import text as T
from recollect.functions import times as C
from recollect.operators.ordered import HOT_ROWS
from recollect.operators.timeline import with_turn_order
from recollect.session import written


def memory_projection(payloads):
    """Q1: typed columns of every stored payload."""
    rows = payloads.withColumn("_v", J.parsed("data_json"))
    v = F.col("_v")
    app = J.string_field(v, "app_name")
    return rows.select(
        "id", "time_start", "level", v.isNull().alias("malformed"),
        F.coalesce(app, F.lit("")).alias("app_name"), J.json_title("data_json", v).alias("window_title"),
        J.json_text("data_json", v).alias("text"), J.text_preview("data_json", v).alias("preview"),
        J.is_screen_event("data_json", v).alias("is_screen"), J.is_qa_event("data_json", v).alias("is_qa"),
        F.try_variant_get(v, "$.is_stress", "boolean").alias("is_stress"))


def projection_report(projected, by="level"):
    return projected.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("malformed").alias("malformed"),
        F.count_if("is_screen").alias("screen"), F.count_if("is_qa").alias("qa"),
        F.sum(F.length("preview")).alias("preview_chars"))


def clean_document(text, lang):
    return T.strip_cjk(T.strip_markers(T.clean_noise_chars(T.clean_lines(text))), lang)


def clean_corpus(docs):
    """Q2: what cleaning removes, per source and language."""
    rows = docs.withColumn("_clean", clean_document("text", "lang"))
    gone = F.length("text") - F.length("_clean")
    return rows.groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(gone).alias("chars_removed"),
        F.count_if(T.trim_ws("_clean") == "").alias("emptied"))


def tag_pairs(tagged, by=("source",)):
    """Q3: rows per pair of tags they share.

    A row has at most four tags, so its pairs are formed inside the row; there
    is no self-join to blow up on a common tag."""
    pairs = F.flatten(F.transform("tags", lambda a: F.transform(
        F.filter("tags", lambda b: b > a), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    return (tagged.withColumn("_p", F.explode(pairs)).groupBy(*by, "_p.tag_a", "_p.tag_b")
            .agg(F.count(F.lit(1)).alias("n")))


def activity_mix(with_phrases):
    """Q4: rows per category, stream and hour, with subtotals and a grand total."""
    return with_phrases.rollup("category", "stream", C.hour_bucket("time_start").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"))


def routed(asks, limit=HOT_ROWS):
    """Questions with route, follow-up flag and web need."""
    rows = asks.withColumn("subject", K.entity_in_question("text"))
    o = with_turn_order(rows, limit)
    o.last_known([("_entity", F.col("subject")), ("_prev", F.col("text"))], inclusive=False)
    return o.result().withColumns({
        "route": K.query_route("text", F.col("_entity").isNotNull()),
        "followup": K.is_followup("text", F.col("_prev").isNotNull()),
        "web": K.needs_web("text")}).drop("_entity", "_prev")


def query_mix(routed_asks):
    """Q5: questions per day, route and follow-up flag, with their share of the day. What else
    `routed` adds is not computed here."""
    per = routed_asks.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "route", "followup").agg(
        F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("day"))
    return per.withColumn("share", F.round(share, 6))


USED_WORDS = 300_000  # words of subjects that are handed to every task; more are met by a shuffle
SET_ROWS = 1_000_000  # sets of words that one task counts over its documents
DENSE = 256           # documents of a range from which a word's places are kept as bits


def _unions(places, sets):
    """Of one range of documents: how many hold a word of each set. places: (_word, _bit); sets:
    (_set, _ids)."""
    word, bit = (places.column(c).to_numpy().astype(np.int64) for c in ("_word", "_bit"))
    order = np.argsort(word, kind="stable")
    word, bit = word[order], bit[order]
    ids, starts = np.unique(word, return_index=True)
    where = dict(zip(ids.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(word)])))
    bits, sizes = {}, {}
    for i, (lo, hi) in where.items():
        if hi - lo >= DENSE:
            row = np.zeros(32768, bool)
            row[bit[lo:hi]] = True
            bits[i] = np.packbits(row, bitorder="little")
            sizes[i] = int(row.sum())
    numbers, counts = [], []
    for number, mine in zip(sets.column("_set").to_pylist(), sets.column("_ids").to_pylist()):
        dense = [i for i in mine if i in bits]
        rare = [bit[slice(*where[i])] for i in mine if i in where and i not in bits]
        union = bits[dense[0]] if dense else None
        for i in dense[1:]:
            union = union | bits[i]
        n = sizes[dense[0]] if len(dense) == 1 else int(np.bitwise_count(union).sum()) if dense else 0
        if rare:
            rest = np.unique(np.concatenate(rare))
            n += int(((union[rest >> 3] >> (rest & 7)) & 1 == 0).sum()) if dense else len(rest)
        if n:
            numbers.append(number)
            counts.append(n)
    return pa.table({"_set": pa.array(numbers, pa.int64()), "_n": pa.array(counts, pa.int64())})


def subject_index(asks, docs, doc_key="doc_id", set_rows=SET_ROWS, used_words=USED_WORDS):
    """Q6: subjects named in questions and the number of documents that hold one of their words.

    doc_key: a whole number. Subjects with the same words are counted once, in ranges of 32768 keys:
    a range gets the places of its words and the sets of words (by number), never bits for each
    subject; no more than `set_rows` sets meet a range in one task."""
    subj = asks.withColumn("subject", K.named_entity("text")).filter(F.col("subject").isNotNull())
    stats = subj.groupBy("subject").agg(F.count(F.lit(1)).alias("asked"),
                                        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    stats = written(stats.withColumn("_words", F.array_sort(F.array_distinct(F.filter(F.transform(
        T.words("subject"), lambda w: F.lower(T.trim_alnum(w))), lambda w: F.length(w) >= 3)))), "subjects")
    wanted = stats.select("_words").distinct()
    used = written(wanted.select(F.explode("_words").alias("word")).distinct().select(
        "word", F.monotonically_increasing_id().alias("_word")), "subject-words")
    used = F.broadcast(used) if used.limit(used_words + 1).count() <= used_words else used
    words = docs.filter(F.col(doc_key).isNotNull()).select(F.col(doc_key).cast("long").alias("_doc"), F.explode(F.array_distinct(
        F.transform(T.words("text"), lambda w: F.lower(T.trim_alnum(w))))).alias("word"))
    sets = written(wanted.withColumn("word", F.explode("_words")).join(used, "word").groupBy("_words").agg(
        F.collect_list("_word").alias("_ids")).withColumn("_set", F.monotonically_increasing_id()), "word-sets")
    parts = sets.count() // set_rows + 1
    places = words.join(used, "word").select(F.bitmap_bucket_number("_doc").alias("_bucket"), "_word", F.bitmap_bit_position(
        "_doc").cast("int").alias("_bit"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    ranges = docs.filter(F.col(doc_key).isNotNull()).select(F.bitmap_bucket_number(F.col(doc_key).cast("long")).alias("_bucket")).distinct()
    dealt = sets.select("_set", "_ids", F.pmod(F.xxhash64("_set"), F.lit(parts)).cast("int").alias("_part")).crossJoin(F.broadcast(ranges))
    unions = places.groupBy("_bucket", "_part").cogroup(dealt.groupBy("_bucket", "_part")).applyInArrow(_unions, "_set long, _n long")
    counted = unions.groupBy("_set").agg(F.sum("_n").alias("docs")).join(sets, "_set").select("_words", "docs")
    return stats.join(counted, "_words", "left").select(
        "subject", "asked", "first_ts", "last_ts", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"))


def code_skeletons(docs):
    """Q7: size of code documents before and after reduction, per source."""
    out = docs.withColumn("_s", T.summarize_code("text"))
    return out.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"),
        F.sum(F.length("_s")).alias("kept_chars"),
        F.round(F.sum(F.length("_s")) / F.sum(F.length("text")), 6).alias("ratio"))


def answer_audit(answers):
    """Q8: per day, how many answers state numbers or months the facts lack."""
    clean = answers.withColumn("_a", T.extract_answer("raw"))
    rep = clean.withColumn("_r", N.grounding_report("_a", "facts"))
    nums, months = F.size("_r.numbers"), F.size("_r.months")
    return rep.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("answers"), F.count_if((nums == 0) & (months == 0)).alias("grounded"),
        F.sum(nums.cast("long")).alias("bad_numbers"), F.sum(months.cast("long")).alias("bad_months"),
        F.sum(F.length("_a").cast("long")).alias("chars"))
