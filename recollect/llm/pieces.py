"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text the encoding has a unique last token. Going left to right,
an automaton names the tokens that end at a place; the last token is the one whose own
start is a prefix with a last token that it is compatible with, that is, the two texts
laid end to end encode to just these two tokens. The ids are then read backwards.

No piece has a word mark after another character, and unknown characters never merge,
so a text falls into chunks that are encoded alone; equal chunks are looked up in a
bounded cache, as are compatibility tests.
"""

import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from ahocorasick import Automaton
from pyspark.sql import functions as F

from recollect.llm.common import Cache, in_parts, utf8

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")
CACHE_ENTRIES = 200_000
LONGEST = 64  # characters of a chunk that is remembered


class PieceCoder:
    def __init__(self, model_file):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        if size > 65536:
            raise ValueError("the model has more than 65536 pieces")
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte = [0] * 256
        self.out = []
        self.ids, self.score = {}, {}
        for i, p in enumerate(self.piece):
            if model.is_byte(i):
                value = int(p[3:5], 16)
                self.byte[value] = i
                self.out.append(bytes([value]))
            elif model.is_control(i):
                self.out.append(b"")
            elif model.is_unknown(i):
                self.out.append(" ⁇ ".encode())
            else:
                self.out.append(p.replace(MARK, " ").encode())
                self.ids[p] = i
                self.score[p] = model.get_score(i)
        self.known = {p for p in self.ids if len(p) == 1}
        self.automaton = Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.bonds = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}  # two characters inside a piece
        self.merges = {}
        self.pairs = Cache(self.fits, CACHE_ENTRIES)
        self.chunks = Cache(self.chunk, CACHE_ENTRIES)

    def history(self, token):
        """How a token's text merges when alone, best score first, the leftmost on ties:
        whether it ends as the token, and after each merge the first and last parts."""
        got = self.merges.get(token)
        if got is None:
            parts = list(self.piece[token])
            steps = [(None, parts[0], parts[-1])]
            while len(parts) > 1:
                score, i = max(((self.score[p], -i) for i, p in enumerate(map(str.__add__, parts, parts[1:]))
                                if p in self.score), default=(None, 0))
                if score is None:
                    break
                parts[-i:2 - i] = [parts[-i] + parts[1 - i]]
                steps.append((score, parts[0], parts[-1]))
            got = self.merges[token] = (len(parts) == 1, steps)
        return got

    def fits(self, key):
        """May token key % 65536 follow token key // 65536 (-1: nothing before it)?

        Laid end to end, each of the two merges as when alone, the better score first,
        until a merge across the border would come before both; then they do not fit."""
        left, right = divmod(key, 65536)
        whole, b = self.history(right)
        if left < 0 or not whole:
            return whole
        whole, a = self.history(left)
        i, j = 1, 1
        while whole:
            across = self.score.get(a[i - 1][2] + b[j - 1][1])
            next_a = a[i][0] if i < len(a) else None
            next_b = b[j][0] if j < len(b) else None
            if across is not None and (next_a is None or across > next_a) and (next_b is None or across >= next_b):
                return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or next_a is not None and next_a >= next_b:
                i += 1
            else:
                j += 1
        return False

    def known_run(self, text):
        """Ids of a text of known characters."""
        n = len(text)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(text):
            start = end + 1 - size
            if (start == 0 or last[start] >= 0) and pairs[last[start] * 65536 + token]:
                last[end + 1], length[end + 1] = token, size
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("a prefix without a last token")
            out.append(last[n])
            n -= length[n]
        return out[::-1]

    def chunk(self, text):
        if 1 < len(text) <= LONGEST and text[-2:] not in self.bonds:  # no piece spans the two: apart
            return self.chunks[text[:-1]] + self.chunks[text[-1]]
        out, run = [], []
        for c in text:
            if c in self.known:
                run.append(c)
                continue
            if run:
                out += self.known_run("".join(run))
                run = []
            out += [self.byte[b] for b in c.encode("utf-8")]
        if run:
            out += self.known_run("".join(run))
        return array("H", out).tobytes()

    def encode(self, text):
        """All ids with begin and end, as 16-bit numbers."""
        out = [array("H", [self.begin]).tobytes()]
        if text:
            known = self.chunks.__getitem__
            out += [known(c) if len(c) <= LONGEST else self.chunk(c) for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
        out.append(array("H", [self.end]).tobytes())
        return np.frombuffer(b"".join(out), np.uint16)

    def decode(self, ids):
        """The text of ids: marks are spaces, byte tokens join to characters, the
        space put before the text goes."""
        table = self.out
        data = b"".join(map(table.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def coder_of(model_file):
    """One for each Python worker, which serves many tasks."""
    return PieceCoder(model_file)


def encode_docs(docs, model_file, texts=False):
    """`doc_id`, `n_tokens`, `ids_sha256`, `decoded_sha256` per row; with texts=True
    `ids` and `decoded` instead of the digests.

    Null text is empty: the begin and end ids alone. Repeated rows get equal answers;
    an empty table gives an empty table.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    tail = "ids array<int>, decoded string" if texts else "ids_sha256 string, decoded_sha256 string"
    names = ["doc_id", "n_tokens", *(["ids", "decoded"] if texts else ["ids_sha256", "decoded_sha256"])]

    def run(batches):
        coder = coder_of(model_file)
        for b in in_parts(batches):
            counts, first, second = [], [], []
            for t in b.column(1):
                ids = coder.encode(t.as_py())
                decoded = coder.decode(ids.tolist())
                counts.append(len(ids))
                first.append(ids.tolist() if texts else hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                second.append(decoded if texts else hashlib.sha256(utf8(decoded)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.list_(pa.int32()) if texts else pa.string()),
                 pa.array(second, pa.string())], names=names)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, {tail}")
