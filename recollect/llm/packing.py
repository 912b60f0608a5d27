"""Lexical retrieval packing.

Documents are tokenised once and the ids written. A shard is a block of documents of a
bounded number of tokens; its BM25 inverted index holds the block's postings by token,
with document frequencies and the mean length counted over all documents. A seed
document opens a window; the index returns the unused documents of the shard by BM25
against the seed, and they fill the window in that order. The last one is cut where the
window is full, and its rest is the seed of the next window. What a shard has left at
the end goes into sequences whose lengths are powers of two, so nothing is padded.

Shards are ranges of (signature, doc_id), found from sampled splitters: the signature is
a minimum hash of token triples, so likely neighbours meet, and a signature that a third
of all documents share is cut into ranges of doc_id. Whatever the ranges hold, a task
closes a block at `block_tokens`, which bounds its memory.
"""

import zlib
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from recollect.llm.common import Cache, in_parts, stored, utf8

CACHE_ENTRIES = 300_000
MARKER = b"<|"  # added tokens begin so
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII, without the apostrophe, which may join letters
DENSE = 4 << 20  # numbers in the matrix of common ids, at most
BYTES = 16 << 20  # of texts whose parts are looked up together
LONGEST = 64  # bytes of a part that is remembered
LATIN = "\u00ff"
VOCABULARY = 65536  # ids are held in 16 bits
NO_PAST = np.uint64(0x9E3779B97F4A7C15)


class Coder:
    """Ids of whole texts, as 16-bit little-endian bytes.

    The tokenizer drops white space and never joins across it, so the white-space
    separated parts of a text are encoded on their own and remembered."""

    def __init__(self, path):
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > VOCABULARY:
            raise ValueError("the vocabulary has more than 65536 ids")
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.splitter = self.tokenizer.pre_tokenizer
        self.parts = Cache(self.encode, CACHE_ENTRIES)
        # The character the pre-tokenizer shows for each byte of such letters.
        self.shown = {b: chr(b) for b in range(0x61, 0x7B)}
        for code in range(0xDF, 0x100):
            for byte, c in zip(chr(code).encode(), self.splitter.pre_tokenize_str(chr(code))[0][0] if chr(code).isalpha() else ""):
                self.shown[byte] = c

    def part(self, part):
        """Ids of a white-space separated part. Letters and the signs behind them never share a
        token run, so a word is remembered once, whatever stands behind it."""
        if len(part) > LONGEST:
            return self.encode(part)
        stem = part.rstrip(PUNCTUATION)
        if 0 < len(stem) < len(part) and MARKER not in part:
            last = stem.decode("utf-8")[-1:]
            if last <= LATIN and last.isalnum() and last == last.lower():
                return self.parts[stem] + self.parts[part[len(stem):]]
        return self.parts[part]

    def encode(self, part):
        if part.isalpha() and part.islower():  # ASCII letters are one token run
            return self.run(part.decode())
        text = part.decode("utf-8")
        if text.isalpha() and text.islower() and max(text) <= LATIN:  # nothing to compose, one token run
            return self.run("".join(map(self.shown.__getitem__, part)))
        return self.split(part)

    def run(self, text):
        return array("H", [t.id for t in self.model.tokenize(text)]).tobytes()

    def split(self, part):
        text = part.decode("utf-8")
        if MARKER in part:  # may hold an added token
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.run(p) for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)))

    def texts(self, texts, end):
        """Ids of whole texts, each with the end id. A-Z are lower-cased early, as the
        tokenizer does, except where an added token could then be taken for one. Each
        distinct part of some texts is looked up once."""
        for some in _runs(list(map(utf8, texts))):
            split = [(t if MARKER in t else t.lower()).split() for t in some]
            ids = dict.fromkeys(chain.from_iterable(split))
            for p in ids:
                ids[p] = self.part(p)
            for parts in split:
                yield b"".join(map(ids.__getitem__, parts)) + end

    def text(self, text, end):
        return next(self.texts([text], end))


def _runs(texts):
    """Consecutive texts of about BYTES together."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > BYTES:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


@lru_cache(maxsize=1)
def coder_of(path):
    """One for each Python worker, which serves many tasks."""
    return Coder(path)


def signatures(docs):
    """For each document its smallest mixed hash of three consecutive ids (of all it has, if
    fewer), as signed longs. No document is empty: each has the end id."""
    size = np.fromiter(map(len, docs), np.int64, len(docs))
    ends = np.cumsum(size)
    x = np.concatenate(docs).astype(np.uint64)
    mixed = x.copy()
    mixed[:-2] *= np.uint64(VOCABULARY ** 2)
    mixed[:-2] += x[1:-1] * np.uint64(VOCABULARY)
    mixed[:-2] += x[2:]
    for back in (1, 2):  # the last two places begin no triple; a short document has its ids instead
        at = ends[size >= back] - back
        mixed[at] = np.where(size[size >= back] < 3, x[at], 0)
    none = np.concatenate([ends[size >= 3] - back for back in (1, 2)])
    mixed ^= mixed >> np.uint64(31)
    mixed *= NO_PAST
    mixed ^= mixed >> np.uint64(29)
    mixed[none] = np.iinfo(np.uint64).max
    return (np.minimum.reduceat(mixed, ends - size) >> np.uint64(1)).astype(np.int64)


def tokenise(docs, path, end=2):
    """doc_id, ids (16-bit little-endian, the end id last), n, signature; and at the end of each
    task a row with `held` alone, the number of its documents that hold each id."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = coder_of(path)
        last = end.to_bytes(2, "little")
        count, seen = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64)
        kind = None
        for b in in_parts(batches):
            if not b.num_rows:
                continue
            ids = list(coder.texts(b.column(1).to_pylist(), last))
            arrays = [np.frombuffer(x, "<u2") for x in ids]
            for x in arrays:
                count[distinct(x, seen)] += 1
            kind = b.column(0).type
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) for x in arrays], pa.int64()),
                 pa.array(signatures(arrays)), pa.nulls(len(ids), pa.binary())], names=names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                 pa.array([count.tobytes()], pa.binary())], names=names)

    names = ["doc_id", "ids", "n", "signature", "held"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary, n bigint, signature bigint, held binary")


def distinct(ids, seen):
    """The ids of a document, each once. seen: scratch space over the vocabulary."""
    places = np.arange(len(ids))
    seen[ids] = places
    return ids[seen[ids] == places]


def frequencies(held):
    """Documents that hold each id, as an array over the vocabulary (65,536 counts)."""

    def run(batches):
        count = np.zeros(VOCABULARY, np.int64)
        for b in batches:
            for x in b.column(0):
                count += np.frombuffer(x.as_py(), np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used])], names=["id", "df"])

    rows = held.select("held").mapInArrow(run, "id bigint, df bigint").groupBy("id").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(VOCABULARY, np.int64)
    for r in rows:
        out[r["id"]] = r["df"]
    return out


def _pairs(docs, counts=False):
    """document * VOCABULARY + id for the ids of each document, in order, each once."""
    number = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    small = np.uint32 if len(docs) < VOCABULARY else np.uint64
    keys = number.astype(small) * small(VOCABULARY) + np.concatenate(docs).astype(small)
    return np.unique(keys, return_counts=counts)


class Index:
    """BM25 postings of a block of documents.

    The ids that a tenth of the documents or more hold are rows of a dense matrix, as their
    postings would be most of the work; the others are postings."""

    def __init__(self, docs, idf, mean, k1=1.2, b=0.75):
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        keys, tf = _pairs(docs, counts=True)
        n = self.n = len(docs)
        doc, term = (keys // VOCABULARY).astype(np.int64), (keys % VOCABULARY).astype(np.int64)
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / mean))
        held = np.bincount(term, minlength=VOCABULARY)
        common = np.flatnonzero(held * 10 >= n)[:DENSE // max(n, 1)]
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        at = self.row[term]
        often, rare = at >= 0, np.flatnonzero(at < 0)
        self.dense = np.zeros((len(common), n))
        self.dense[at[often], doc[often]] = weight[often]
        self.rows, self.first_row = at[often], np.searchsorted(doc[often], np.arange(n + 1))
        self.terms, self.first = term[rare], np.searchsorted(doc[rare], np.arange(n + 1))
        order = rare[np.argsort(term[rare], kind="stable")]
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(VOCABULARY + 1))

    def scores(self, seed):
        """BM25 of every document of the block against the ids of one of them."""
        terms = self.terms[self.first[seed]:self.first[seed + 1]]
        begin = self.start[terms]
        size = self.start[terms + 1] - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rows = self.rows[self.first_row[seed]:self.first_row[seed + 1]]
        return np.bincount(self.doc[at], self.weight[at], self.n) + self.dense[rows].sum(0)


def ranked(scores, left, some=32):
    """The documents `left` by falling score, ties to the earlier one; only as many as are
    asked for are sorted."""
    s = scores[left]
    if len(left) > 2 * some:
        edge = np.partition(s, len(s) - some)[len(s) - some]
        above = np.flatnonzero(s > edge)
        yield from left[above[np.argsort(-s[above], kind="stable")]].tolist()
        yield from left[s == edge].tolist()
        left, s = left[s < edge], s[s < edge]
    yield from left[np.argsort(-s, kind="stable")].tolist()


def pack_block(docs, idf, mean, window):
    """Sequences of one block: lists of (document, start, length)."""
    index = Index(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    waiting = 0  # the first document that may be unused
    out, rest = [], None
    while True:
        if rest is None:
            while waiting < len(docs) and not unused[waiting]:
                waiting += 1
            if waiting == len(docs):
                break
            rest = (waiting, 0)
            unused[waiting] = False
        seed, start = rest
        length = min(window, len(docs[seed]) - start)
        pieces, room = [(seed, start, length)], window - length
        rest = (seed, start + length) if start + length < len(docs[seed]) else None
        if room:
            for d in ranked(index.scores(seed), np.flatnonzero(unused)):
                length = min(room, len(docs[d]))
                pieces.append((d, 0, length))
                unused[d] = False
                room -= length
                if length < len(docs[d]):
                    rest = (d, length)
                if not room:
                    break
        out.append(pieces)
    if out and sum(p[2] for p in out[-1]) < window:
        out[-1:] = powers(out[-1])
    return out


def powers(pieces):
    """A short sequence cut into sequences whose lengths are powers of two."""
    total = sum(p[2] for p in pieces)
    out, room = [], 0
    for doc, start, length in pieces:
        while length:
            if not room:
                room = 1 << (total.bit_length() - 1)
                out.append([])
            take = min(room, length)
            out[-1].append((doc, start, take))
            start, length, room, total = start + take, length - take, room - take, total - take
    return out


def _packer(frequency, rows, tokens, window, block_tokens, with_ids, id_type):
    idf = np.log1p((rows - frequency + 0.5) / (frequency + 0.5))
    mean = max(1.0, tokens / max(rows, 1))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"] + ["ids"] * with_ids

    def run(batches):
        ids, docs, held, number = [], [], 0, 0

        def flush():
            nonlocal held, number
            columns = [[] for _ in names]
            for pieces in pack_block(docs, idf, mean, window):
                offset = 0
                for d, start, length in pieces:
                    own = docs[d][start:start + length].astype("<u4")
                    row = [ids[d], start, length, zlib.crc32(own.tobytes()), len(docs[d]), number, offset]
                    for c, v in zip(columns, row + [own.tolist()] * with_ids):
                        c.append(v)
                    offset += length
                number += 1
            ids.clear(), docs.clear()
            held = 0
            kinds = [id_type] + [pa.int64()] * 6 + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                docs.append(np.frombuffer(x.as_py(), "<u2"))
                held += len(docs[-1])
                if held >= block_tokens:
                    yield flush()
        if docs:
            yield flush()

    return run


def pack(docs, tokenizer, window=4096, end=2, shard_tokens=1 << 20, block_tokens=1 << 22, with_ids=False):
    """Pack documents into sequences of at most `window` tokens (a power of two).

    Returns a row per piece: `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`,
    `sequence_id`, `offset`, and `ids` if asked for.

    Null and empty texts have the end id alone. Repeated rows are packed one by one.
    Ties in a ranking go to the earlier document of the shard. A document longer than
    the window fills several. An empty table gives an empty table.
    """
    id_type = docs.schema["doc_id"].dataType
    written = stored(tokenise(docs, tokenizer, end), "token-ids")
    frequency = frequencies(written.where("held is not null"))
    tokens = written.where("n is not null")
    rows, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = max(1, -(-total // shard_tokens))
    placed = tokens.select("doc_id", "ids", "signature").repartitionByRange(shards, "signature", "doc_id")
    tail = ", ids array<int>" if with_ids else ""
    arrow = to_arrow_type(id_type)
    out = placed.sortWithinPartitions("signature", "doc_id", "ids").select("doc_id", "ids").mapInArrow(
        _packer(frequency, rows, total, window, block_tokens, with_ids, arrow),
        f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        f"sequence bigint, offset bigint{tail}")
    # A task numbers its sequences; with the task's number they are unique.
    number = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("sequence")
    return out.withColumn("sequence_id", number).drop("sequence")
