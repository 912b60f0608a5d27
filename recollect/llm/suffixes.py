"""Suffix-array dedup of byte strings that occur before, in any document.

A full suffix array of the corpus would hold a row per byte. Here the suffixes that are
sorted are those at anchors chosen by content (see anchors.py): each stands for a run of
up to `width - gram + 1` windows of `width` bytes, and equal windows have equal anchors.

1. A row per run: its leading key (the first bytes of the anchor's suffix, then a
   fingerprint of its first `gram` bytes), the fingerprint of all bytes that the run's
   windows cover, and its place. Sampled splitters range-partition the rows; a bucket
   sorts its rows by leading key, then content, then place (a multikey sort: each key
   only orders what the one before left equal) and compares neighbours. What a bucket
   cannot know, whether its first group began in an earlier bucket, is settled by
   comparing across bucket borders, one small row per bucket. A string that a third of
   all documents hold is thus spread over many buckets.
2. Equal content: every row but the first is a repeat with all its windows. Runs that
   share a leading key but not the content overlap in part: their windows, a row each,
   are sorted and compared in the same way.
3. The repeated spans of a document are gathered, merged and cut out of its text.
"""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.llm import anchors
from recollect.llm.common import in_parts, release, stored, utf8

PLACE = ["doc_id", "part", "at"]
COUNT = 10  # bits of a row's `spot` that hold the number of windows; the rest is where they begin


def spots(at, count):
    return (at << COUNT) | count


def names_of(rows):
    """The columns that name a document: `part` only where an id has several texts."""
    return [c for c in ("doc_id", "part") if c in rows.columns]


def _texts(batch_, column):
    return [utf8(t) for t in batch_.column(column).to_pylist()]


def _laid_out(texts, width):
    """Texts laid end to end in arrays of a bounded length; a long text comes in parts
    that overlap by width - 1 bytes. Yields bytes, ends, text index, start in the text."""
    limit = anchors.SEGMENT
    pieces, size = [], 0
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - width + 1), limit):
            part = t[start:start + limit + width - 1]
            if len(part) < width:
                continue
            if size and size + len(part) > limit + width:
                yield _joined(pieces)
                pieces, size = [], 0
            pieces.append((i, start, part))
            size += len(part)
    if pieces:
        yield _joined(pieces)


def _joined(pieces):
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    ends = np.cumsum([len(p[2]) for p in pieces])
    return data, ends, np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces], np.int64), \
        ends - np.array([len(p[2]) for p in pieces])


def run_rows(base, width, gram):
    """A row per run: lead, whole (content), the document's name, spot (place and windows)."""
    named = names_of(base)

    def run(batches):
        for b in in_parts(batches):
            for data, ends, index, start, begin in _laid_out(_texts(b, len(named)), width):
                text, first, last, lead, whole = anchors.runs(data, ends, width, gram)
                if not len(first):
                    continue
                rows = pa.array(index[text])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead.view(np.int64)), pa.array(whole.view(np.int64)),
                     *[b.column(i).take(rows) for i in range(len(named))],
                     pa.array(spots(first - begin[text] + start[text], last - first + 1))],
                    names=["lead", "whole", *named, "spot"])

    return base.mapInArrow(run, "lead bigint, whole bigint, " + "".join(f"{c} bigint, " for c in named) + "spot bigint")


def joined_up(docs, at, count):
    """Windows in order as (rows, at, count): those that touch the row before them, in the same
    document, are one. A run of equal bytes, whose windows are rows of their own, becomes short."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] < at[:-1]) | (at[1:] > at[:-1] + count[:-1])
    for d in docs:
        new[1:] |= d[1:] != d[:-1]
    first = np.flatnonzero(new)
    return first, at[first], np.maximum.reduceat(at + count, first) - at[first]


def _compare(with_edges):
    """Neighbours of a sorted bucket. Rows out: kind 0: repeats; kind 1: the first of
    its content here, with `open` 0 (its leading key begins and ends in this bucket), 1
    (the leading key of the bucket's first row) or 2 (that of its last row); kind 2: the
    bucket's first and last row. `head` marks the first row of the bucket."""
    names = ["kind", "open", "head", "lead", "whole", *PLACE, "count", "bucket"]

    def run(batches):
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId()
        first = last = None
        held = []  # firsts of the leading key that may go on

        def rows(kind, head, lead, whole, docs, at, count):
            n = len(lead)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(head), pa.array(lead),
                 pa.array(whole), *docs, at, pa.array(count), pa.array(np.full(n, bucket, np.int32))], names=names)

        def opened(part, open_):
            return part.set_column(1, "open", pa.array(open_.astype(np.int32)))

        for b in batches:
            if not b.num_rows:
                continue
            lead, whole, spot = (b.column(i).to_numpy() for i in (0, 1, b.num_columns - 1))
            at, count = spot >> COUNT, spot & ((1 << COUNT) - 1)
            docs = [b.column(i) for i in range(2, b.num_columns - 1)]

            def docs_at(places):
                taken = [d.take(pa.array(places)) for d in docs]
                return taken if len(taken) == 2 else [*taken, pa.array(np.zeros(len(places), np.int64))]

            before = last
            same = np.empty(len(lead), bool)
            same[1:] = (lead[1:] == lead[:-1]) & (whole[1:] == whole[:-1])
            same[0] = before == (lead[0], whole[0])
            first = first or (lead[0], whole[0])
            last = (lead[-1], whole[-1])
            repeat, new = np.flatnonzero(same), np.flatnonzero(~same)
            if len(repeat):
                first_of, start, n = joined_up([d.to_numpy()[repeat] for d in docs], at[repeat], count[repeat])
                none = np.zeros(len(n), np.int64)
                yield rows(0, none.astype(bool), none, none, docs_at(repeat[first_of]), pa.array(start), n)
            if not with_edges:
                new = new[:before is None]  # of the firsts, only the bucket's first row is asked for
            if not len(new):
                continue
            head = np.zeros(len(new), bool)
            head[0] = before is None
            held.append(rows(1, head, lead[new], whole[new], docs_at(new), pa.array(at[new]), count[new]))
            part = pa.concat_batches(held)
            leads = part.column(3).to_numpy()
            cut = int(np.argmax(leads == leads[-1]))
            done, held = part.slice(0, cut), [part.slice(cut)]
            if cut:
                _, inverse, sizes = np.unique(leads[:cut], return_inverse=True, return_counts=True)
                border = leads[:cut] == first[0]
                yield opened(done, border).filter(pa.array(border | (sizes[inverse] > 1)))
        if first is not None:
            for part in held:
                yield opened(part, np.full(part.num_rows, 1 if part.column(3)[0].as_py() == first[0] else 2))
            keys = np.array([first, last], np.int64)
            none = pa.nulls(2, pa.int64())
            yield rows(2, np.array([True, False]), keys[:, 0], keys[:, 1], [none, none], none, np.zeros(2, np.int64))

    return run


SORTED = ("kind int, open int, head boolean, lead bigint, whole bigint, doc_id bigint, part bigint, at bigint, "
          "count bigint, bucket int")


def sort_and_compare(rows, buckets, name, with_edges):
    """Repeats and (if asked for) the firsts whose leading key has other content too.

    rows: lead, whole, name, spot. Both results have the place and count."""
    keys = ["lead", "whole", *names_of(rows), "spot"]
    found = stored(rows.repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
                   .mapInArrow(_compare(with_edges), SORTED), name)
    spark = rows.sparkSession
    release(spark)
    # Across borders: two rows per bucket, and for the border keys two counts per bucket.
    ends = {}
    for r in found.where("kind = 2").select("bucket", "head", "lead", "whole").collect():
        ends.setdefault(r["bucket"], {})[r["head"]] = (r["lead"], r["whole"])
    order = sorted(ends)
    continued = [b for a, b in zip(order, order[1:]) if ends[a][False] == ends[b][True]]
    goes_on = spark.createDataFrame([[b] for b in continued], "bucket int")
    firsts = found.where("kind = 1")
    late = firsts.where("head").join(F.broadcast(goes_on), "bucket")
    repeats = found.where("kind = 0").select(*PLACE, "count").unionByName(late.select(*PLACE, "count"))
    if not with_edges:
        return repeats, None
    contents = Counter()
    for r in firsts.where("open > 0").groupBy("bucket", "lead").agg(F.count(F.lit(1)).alias("n")).collect():
        contents[r["lead"]] += r["n"]
    contents.subtract(ends[b][True][0] for b in continued)
    shared = spark.createDataFrame([[x] for x, n in contents.items() if n > 1], "lead bigint")
    settled = firsts.where("open = 0")
    border = firsts.where("open > 0").join(F.broadcast(shared), "lead", "left_semi").join(
        F.broadcast(goes_on.withColumn("head", F.lit(True))), ["bucket", "head"], "left_anti")
    columns = ["lead", *PLACE, "count"]
    return repeats, settled.select(columns).unionByName(border.select(columns))


def window_rows(docs, edges, width):
    """A row per window of the edge runs: lead, whole (the window's fingerprint), name, spot."""
    named = names_of(docs)
    lists = edges.groupBy(*named).agg(F.collect_list(F.struct("at", "count", "lead")).alias("runs"))
    joined = docs.join(lists, named).select(*named, "text", "runs")

    def run(batches):
        for b in in_parts(batches):
            for i, text in enumerate(_texts(b, len(named))):
                runs = b.column(len(named) + 1)[i].values
                at, count, lead = (runs.field(k).to_numpy() for k in ("at", "count", "lead"))
                data = np.frombuffer(text, np.uint8)
                for start in range(0, len(data), anchors.SEGMENT):
                    mine = (at >= start) & (at < start + anchors.SEGMENT)
                    if not mine.any():
                        continue
                    n = count[mine]
                    places = np.repeat(at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    part = data[start:start + anchors.SEGMENT + 2 * width]
                    whole = anchors.Hashes(part, 1).of(places - start, places - start + width)
                    one = pa.array(np.full(len(places), i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(lead[mine], n)), pa.array(whole.view(np.int64)),
                         *[b.column(k).take(one) for k in range(len(named))], pa.array(spots(places, 1))],
                        names=["lead", "whole", *named, "spot"])

    return joined.mapInArrow(run, "lead bigint, whole bigint, " + "".join(f"{c} bigint, " for c in named) + "spot bigint")


def merge_spans(starts, ends):
    """Overlapping and touching spans joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


def repeated_spans(docs, width=100, gram=50, bucket_rows=400_000):
    """`doc_id`, `part`, `spans` (array of struct at, count): the repeated windows of
    each document that has some. docs: doc_id, part (where an id has several texts), text;
    no repeated rows."""
    if width - gram + 1 >= 1 << COUNT:
        raise ValueError(f"a run may hold at most {(1 << COUNT) - 1} windows: choose a longer gram")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    density = 2 / (width - gram + 2)
    buckets = max(1, int(size * density / bucket_rows) + 1)
    runs = run_rows(docs, width, gram)
    repeats, edges = sort_and_compare(runs, buckets, "suffix-runs", True)
    windows = window_rows(docs, edges, width)
    more, _ = sort_and_compare(windows, buckets, "suffix-windows", False)
    spans = repeats.unionByName(more)
    return spans.groupBy("doc_id", "part").agg(F.collect_list(F.struct("at", "count")).alias("spans"))


def remove_repeats(docs, width=100, gram=50, texts=False):
    """Cut every byte out of a document's text that a `width`-byte string covers which
    also starts earlier: in a smaller doc_id, or before in the same document.

    Returns `doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256` per row; with
    texts=True `row` (all columns as they came) and `kept_text` instead of the digest,
    where a character that lost a byte is left out whole.

    Strings are judged on the input. Null text is empty. A null doc_id comes before all
    others. Rows with one doc_id and different texts are different documents, ordered by
    a hash of the text; rows equal in both are one document and get one answer. Texts
    shorter than `width` stay. An empty table gives an empty table.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    repeated = (ids or 0) > 1
    part = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    # -2**63 stands for null, which no join would match
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    kept = docs.columns if texts else ["doc_id", "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), key.alias("doc_id"), part.alias("part"))
    base = rows.select("doc_id", *["part"] * repeated, F.coalesce("row.text", F.lit("")).alias("text"))
    spans = repeated_spans(base.distinct() if repeated else base, width, gram)
    joined = rows.join(spans, ["doc_id", "part"], "left").select("row", "spans")
    head = joined.schema["row"] if texts else docs.schema["doc_id"]
    last = "kept_text" if texts else "kept_sha256"

    def run(batches):
        for b in in_parts(batches):
            own, lists = b.column(0), b.column(1)
            out = [[] for _ in range(4)]
            for i, text in enumerate(map(utf8, own.field("text").to_pylist())):
                removed, pieces, n = 0, [text], 0
                if lists[i].is_valid:
                    values = lists[i].values
                    at = values.field("at").to_numpy()
                    starts, ends = merge_spans(at, at + values.field("count").to_numpy() + width - 1)
                    removed, n = int((ends - starts).sum()), len(starts)
                    pieces = [text[a:z] for a, z in zip([0, *ends.tolist()], [*starts.tolist(), len(text)])]
                kept = "".join(p.decode("utf-8", "ignore") for p in pieces) if texts else \
                    hashlib.sha256(b"".join(pieces)).hexdigest()
                for c, v in zip(out, (len(text), removed, n, kept)):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([own if texts else own.field("doc_id"), *map(pa.array, out, kinds)],
                                             names=[head.name, "n_bytes", "n_removed", "n_spans", last])

    return joined.mapInArrow(
        run, f"{head.name} {head.dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, {last} string")
