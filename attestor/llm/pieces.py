"""SentencePiece-style encoding by unigram Viterbi over a double-array trie, decoding, and the query op6.

Pieces are read from a public model file (its path is a parameter; nothing is trained). Its scores are merge ranks; the
log score of a piece is that of Zipf's law at its rank. Bytes of characters that no piece covers become byte pieces,
so every text round-trips. Spaces become the marker U+2581 with one in front of the text; a marker that stands in a
text itself is encoded as bytes, so that decoding never takes it for a space. As no piece continues over a marker or
holds a line feed, the best path of a text is the best paths of its stretches, which are remembered in a bounded table.

Defined cases: null is empty; an empty text has no ids; of paths with equal scores the one with the longer last piece
wins; repeated rows each get their row; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, chunks, documents, list_array

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: How a marker of the text itself is held: no UTF-8 byte is 0xFE, so that no piece matches.
_OWN_MARK = b"\xfe\x96\x81"
_STRETCH = re.compile(rb"\n| *[^ \n]+| +")
#: Below the worst piece, for a character that is none.
UNKNOWN_PENALTY = 10.0
#: Stretches up to this many bytes are encoded many at a time.
SHORT = 40
REMEMBERED = 200_000


class Trie:
    """Double array: from node s, byte c leads to base[s] + c + 1 if check there is s; value is a piece's id or -1."""

    def __init__(self, words: list[tuple[bytes, int]]):
        words = sorted(words)
        base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
        free, todo = 1, [(0, 0, len(words), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(words[lo][0]) == depth:
                value[node] = words[lo][1]
                lo += 1
            if lo == hi:
                continue
            edges, i = [], lo
            while i < hi:
                c, j = words[i][0][depth], i
                while j < hi and words[j][0][depth] == c:
                    j += 1
                edges.append((c + 1, i, j))
                i = j
            labels = [e[0] for e in edges]
            at = max(0, free - labels[0])
            tries = 0
            while True:
                if at + 300 > len(check):
                    more = len(check)
                    base, check, value = base + [0] * more, check + [-1] * more, value + [-1] * more
                if all(check[at + x] < 0 for x in labels):
                    break
                at += 1
                tries += 1
            if tries > 32:  # this stretch is nearly full: search behind it from now on
                free = at + labels[0]
            base[node] = at
            for x, i, j in edges:
                check[at + x] = node
                todo.append((at + x, i, j, depth + 1))
        pad = [-1] * 300
        self.base, self.check, self.value = (np.array(x, np.int32) for x in (base + [0] * 300, check + pad, value + pad))

    def find(self, word: bytes) -> int:
        node = 0
        for c in word:
            to = int(self.base[node]) + c + 1
            if self.check[to] != node:
                return -1
            node = to
        return int(self.value[node])


class Pieces:
    """scores: log score by id; table: what each id decodes to (with markers); byte_id: id of each byte piece."""

    def __init__(self, words: list[tuple[bytes, int]], scores: np.ndarray, byte_id: list[int]):
        self.trie, self.scores, self.byte_id = Trie(words), scores, byte_id
        self.longest = max(len(w) for w, _ in words)
        self.unknown = float(min(scores[i] for _, i in words)) - UNKNOWN_PENALTY
        self.table = [b""] * len(scores)
        for w, i in words:
            self.table[i] = w.replace(MARK, b" ")
        for b, i in enumerate(byte_id):
            self.table[i] = bytes([b])
        self._known: dict[bytes, bytes] = {}
        self.lists = None

    def best(self, s: bytes) -> list[int]:
        """Viterbi over one stretch, in plain Python."""
        if self.lists is None:
            self.lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist())
        base, check, value, scores = self.lists
        n = len(s)
        top, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        top[0] = 0.0
        for i in range(n):
            if top[i] == -math.inf:
                continue
            width = char_bytes(s[i])
            node, single = 0, False
            for j in range(i, min(n, i + self.longest)):
                to = base[node] + s[j] + 1
                if check[to] != node:
                    break
                node = to
                if (v := value[node]) >= 0:
                    single |= j + 1 - i == width
                    if (x := top[i] + scores[v]) > top[j + 1]:
                        top[j + 1], back[j + 1] = x, (i, v)
            if not single and (x := top[i] + self.unknown) > top[min(n, i + width)]:
                top[min(n, i + width)], back[min(n, i + width)] = x, (i, -1)
        out, end = [], n
        while end:
            i, v = back[end]
            out += [v] if v >= 0 else [self.byte_id[b] for b in reversed(s[i:end].replace(_OWN_MARK, MARK))]
            end = i
        return out[::-1]

    def best_of_many(self, words: list[bytes]) -> list[list[int]]:
        """Viterbi over many short stretches at once: a column of start places at a time."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max(initial=0))
        text = np.zeros((n, width + 4), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        text[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        top = np.full((n, width + 5), -np.inf)
        start, piece = np.zeros((n, width + 5), np.int16), np.full((n, width + 5), -1, np.int32)
        top[:, 0] = 0.0
        for i in range(width):
            rows = np.flatnonzero((top[:, i] > -np.inf) & (sizes > i))
            chars = _CHAR[text[rows, i]]
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for j in range(i, min(width, i + self.longest)):
                to = base[node] + text[rows[live], j].astype(np.int64) + 1
                ok = (check[to] == node) & (sizes[rows[live]] > j)
                live, node = live[ok], to[ok]
                if not len(live):
                    break
                v = value[node]
                has = v >= 0
                at, ids = live[has], v[has]
                single[at] |= chars[at] == j + 1 - i
                x = top[rows[at], i] + self.scores[ids]
                better = x > top[rows[at], j + 1]
                r = rows[at[better]]
                top[r, j + 1], start[r, j + 1], piece[r, j + 1] = x[better], i, ids[better]
            r = rows[~single]
            end = np.minimum(i + chars[~single], sizes[r])
            x = top[r, i] + self.unknown
            better = x > top[r, end]
            r, end = r[better], end[better]
            top[r, end], start[r, end], piece[r, end] = x[better], i, -1
        out = []
        for k, word in enumerate(words):
            ids, end, s, p = [], len(word), start[k], piece[k]
            while end:
                i, v = int(s[end]), int(p[end])
                ids += [v] if v >= 0 else [self.byte_id[b] for b in reversed(word[i:end].replace(_OWN_MARK, MARK))]
                end = i
            out.append(ids[::-1])
        return out

    def encode_many(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        known = self._known
        split = [_STRETCH.findall(b" " + t.replace(MARK, _OWN_MARK)) if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for words in split for w in words})
        held = [(w, w.replace(b" ", MARK)) for w in new]
        short = [(w, s) for w, s in held if len(s) <= SHORT]
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            for (w, _), ids in zip(part, self.best_of_many([s for _, s in part])):
                known[w] = np.array(ids, np.int32).tobytes()
        for w, s in held:
            if len(s) > SHORT:
                known[w] = np.array(self.best(s), np.int32).tobytes()
        return [np.frombuffer(b"".join([known[w] for w in words]), np.int32) for words in split]

    def decode(self, ids) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids])[1:]  # the first marker is not the text's


_CHAR = np.ones(256, np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:0xF8], _CHAR[0xFE] = 2, 3, 4, 3


def char_bytes(first: int) -> int:
    return int(_CHAR[first])


@lru_cache(maxsize=4)
def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    harmonic = sum(1 / (r + 2.7) for r in range(n))
    words, scores, byte_id = [], np.zeros(n), [0] * 256
    for i in range(n):
        text = model.id_to_piece(i)
        scores[i] = -math.log((max(0.0, -model.get_score(i)) + 2.7) * harmonic)
        if model.is_byte(i):
            byte_id[int(text[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            word = text.encode()
            if MARK.decode() not in text.lstrip(MARK.decode()) and "\n" not in text:  # else a path could cross a stretch's end
                words.append((word, i))
    return Pieces(words, scores, byte_id)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, n_byte_pieces, ids, ids_crc32, round_trip) for each row."""
    pieces = load(path)  # read on the driver, sent with the tasks: executors need no file
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_byte = np.zeros(len(pieces.scores), bool)
        is_byte[pieces.byte_id] = True
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in chunks(texts):
                ids = pieces.encode_many(texts[a:b])
                same = [pieces.decode(x.tolist()) == t for x, t in zip(ids, texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(t) for t in texts[a:b]], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                        list_array(pa.array(np.concatenate(ids)), np.fromiter(map(len, ids), np.int64, b - a)),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_pieces", "n_byte_pieces", "ids", "ids_crc32", "round_trip"],
                )

    schema = "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids array<int>, ids_crc32 long, round_trip boolean"
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""
    pieces = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else pieces.decode(x).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
