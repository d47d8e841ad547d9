"""BPE encoding and decoding with word ends over contiguous rank arrays, and the query op13.

A vocabulary and its merges are read from a public tokenizer file (its path is a parameter; nothing is trained). A text
is normalised (NFC, white space, lower case) and cut into words; a word is a row of its parts, beside it the ranks of the
adjacent pairs. The lowest rank, leftmost first, is scanned for again and again: the boundary in it is deleted from both
rows and the two ranks beside it are looked up anew. Many words take each step side by side, as the rows of one matrix.
Words over SHORT bytes, where the scan would be quadratic, keep a heap of pairs instead, with the same result. Words
are remembered in a bounded table.

Defined cases: null is empty; an empty text, or one of white space only, has no ids and decodes to the empty text;
strings of the added tokens stand for these tokens before anything is normalised; repeated rows each get their row; an
empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SHORT = 96
#: Words that take their steps side by side.
SIDE = 4096
#: Words that a worker remembers, 200 bytes or so each, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 200_000, 48
#: Characters of the rows that are encoded and given out together; a longer text is a batch of its own.
STEP_CHARS = 1 << 19

# What the tokenizer's Unicode tables (letters and numbers of 16, capitals of 17, composition of 9) have
# otherwise than those of Python 3.13 (15.1), as first and last code point --------------------------------------------
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)
#: First and last capital, and the first one's small letter.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Marks that the tokenizer takes for characters that neither compose nor move.
NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E),
    (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42),
    (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
# ----------------------------------------------------------------------------------------------------------------------


def _within(ranges) -> str:
    return "[" + "".join(f"{chr(r[0])}-{chr(r[1])}" for r in ranges) + "]"


_NEW_LETTER, _NEW_NUMBER = re.compile(_within(NEW_LETTERS)), re.compile(_within(NEW_NUMBERS))
_NEW_CAPITAL, _NEW_MARK = re.compile(_within(NEW_CAPITALS)), re.compile(f"({_within(NEW_MARKS)})")
_SMALL = {c: small + c - first for first, last, small in NEW_CAPITALS for c in range(first, last + 1)} | {0x03A3: 0x03C3}
_WORD = re.compile(rf"{CONTRACTIONS}|[a-zA-Z]+|[0-9]|[^a-zA-Z0-9 \t-\r]+")


class _Shadow(dict):
    """For str.translate: letters beyond ASCII become x, numbers 0, white space a space and all else !, so that one ASCII
    pattern cuts words."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind = unicodedata.category(char)[0]
        if code < 128:
            out = char
        elif char.isspace():
            out = " "
        elif kind == "L" or _NEW_LETTER.match(char):
            out = "x"
        else:
            out = "0" if kind == "N" or _NEW_NUMBER.match(char) else "!"
        self[code] = out
        return out


_SHADOW = _Shadow()


def composed(text: str) -> str:
    """NFC by the tokenizer's tables."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return text
    return "".join(x if i % 2 else unicodedata.normalize("NFC", x) for i, x in enumerate(_NEW_MARK.split(text)))


def lowered(text: str) -> str:
    """Lower case of each character by itself: a final sigma is like any other."""
    if text.isascii():
        return text.lower()
    return (text.translate(_SMALL) if "Σ" in text or _NEW_CAPITAL.search(text) else text).lower()


#: Letters without a gap in the code: texts of ASCII and these need no shadow.
_LATIN = "À-ÖØ-öø-ɏ"
_BEYOND, _LATIN_WORD = re.compile(rf"[^\x00-\x7f{_LATIN}]"), re.compile(_WORD.pattern.replace("a-zA-Z", f"a-zA-Z{_LATIN}"))


def words(text: str) -> list[str]:
    if text.isascii():
        return _WORD.findall(text)
    if not _BEYOND.search(text):
        return _LATIN_WORD.findall(text)
    return [text[m.start() : m.end()] for m in _WORD.finditer(text.translate(_SHADOW))]


def _byte_characters() -> list[str]:
    """The visible character of each byte: itself where it is printable Latin-1, else the next of U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


class Bpe:
    """ids: of each token; merges: pairs of tokens by rank; end: what follows the last byte of a word."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int], end: str):
        self.added = added
        self.tokens = {i: t for t, i in {**ids, **added}.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        chars = _byte_characters()
        self.inner, self.last = (np.array([ids[c + e] for c in chars], np.int64) for e in ("", end))
        self.none = len(merges)
        self.result = np.array([ids[a + b] for a, b in merges], np.int64)
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        self.pairs, first = np.unique(pairs, return_index=True)
        self.order = first.astype(np.int64)
        self.known: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of ids; the number of merges where there is none. An id below 0 is no part."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where((self.pairs[at] == pair) & (right >= 0), self.order[at], self.none)

    def symbols(self, word: bytes) -> np.ndarray:
        out = self.inner[np.frombuffer(word, np.uint8)]
        out[-1] = self.last[word[-1]]
        return out

    def merged(self, some: list[bytes]) -> list[bytes]:
        """The packed ids of words of at most SHORT bytes and about equal length, side by side."""
        out: list[bytes] = [b""] * len(some)
        width = max(map(len, some))
        parts = np.full((len(some), width), -1, np.int64)
        for i, word in enumerate(some):
            parts[i, : len(word)] = self.symbols(word)
        number = np.arange(len(some))
        near = self.ranks(parts[:, :-1], parts[:, 1:])
        while True:
            row = np.arange(len(number))
            at = near.argmin(axis=1) if near.shape[1] else np.zeros(len(row), np.int64)
            least = near[row, at] if near.shape[1] else np.full(len(row), self.none)
            open_ = least < self.none
            for i, ids, n in zip(number[~open_].tolist(), parts[~open_].astype("<u4"), (parts[~open_] >= 0).sum(axis=1)):
                out[i] = ids[:n].tobytes()
            if not open_.any():
                return out
            if not open_.all():
                parts, near, number, at, least, row = parts[open_], near[open_], number[open_], at[open_], least[open_], row[: open_.sum()]
            parts[row, at] = self.result[least]
            parts, near = _without(parts, row, at + 1), _without(near, row, at)
            for j, here in ((at - 1, at > 0), (at, at < near.shape[1])):
                r, j = row[here], j[here]
                near[r, j] = self.ranks(parts[r, j], parts[r, j + 1])

    def merged_long(self, word: bytes) -> bytes:
        """The same for one word of any length: a heap of pairs, and links to the parts before and after."""
        parts, n = self.symbols(word), len(word)
        heap = [(r, i) for i, r in enumerate(self.ranks(parts[:-1], parts[1:]).tolist()) if r < self.none]
        heapq.heapify(heap)
        parts, after, before = parts.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        known = {p: r for p, r in zip(self.pairs.tolist(), self.order.tolist())} if heap else {}
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j == n or known.get(parts[i] << 32 | parts[j]) != rank:  # gone or changed meanwhile
                continue
            parts[i], parts[j], after[i] = int(self.result[rank]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := known.get(parts[a] << 32 | parts[after[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """The packed ids of words."""
        raw = sorted((len(b), b, w) for w, b in ((w, w.encode()) for w in new))
        short = bisect.bisect_right(raw, SHORT, key=lambda x: x[0])
        out = {w: self.merged_long(b) for _, b, w in raw[short:]}
        for i in range(0, short, SIDE):
            some = raw[i : min(i + SIDE, short)]
            out.update(zip([w for _, _, w in some], self.merged([b for _, b, _ in some])))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut: list[list[str]] = []
        for text in texts:
            if self.special is None or not (pieces := self.special.split(text))[1:]:
                cut.append(words(lowered(composed(text))))
            else:  # an added token's string holds characters of several kinds, so that it is no word
                cut.append([w for i, x in enumerate(pieces) for w in ([x] if i % 2 else words(lowered(composed(x))))])
        known, asked = self.known, set().union(*cut)
        new = asked - known.keys()
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = asked
        known.update({x: i.to_bytes(4, "little") for x, i in self.added.items()})
        known.update(self.learn(new - self.added.keys()))
        out = [b"".join(map(known.__getitem__, held)) for held in cut]
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                known.pop(w, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _without(matrix: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """matrix less one entry of each row: the rest moves up."""
    left = np.ones(matrix.shape, bool)
    left[row, column] = False
    return matrix[left].reshape(len(matrix), matrix.shape[1] - 1)


@lru_cache(maxsize=2)
def parsed(spec: bytes) -> Bpe:
    """A tokenizer file's contents. Only the form that this module implements is taken."""
    whole = json.loads(spec)
    model, kinds = whole["model"], [x["type"] for x in (whole["normalizer"] or {}).get("normalizers", [])]
    plain = not (model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"))
    if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or not plain or whole["decoder"] or any(x["normalized"] for x in whole["added_tokens"]):
        raise ValueError("not a lower-case BPE with word ends and without a decoder")
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return Bpe(model["vocab"], merges, {x["content"]: x["id"] for x in whole["added_tokens"]}, model["end_of_word_suffix"])


def specification(path: str | None = None) -> bytes:
    """The file's bytes, read on the driver and sent with the tasks: executors need no file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_bytes()


def encode(docs: DataFrame, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row; ids are packed as in a training file: little-endian, 4 bytes each. decoded:
    with a column of that name, what the ids decode to, in the same pass over the rows."""
    spec = specification(path)
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = parsed(spec)
        for batch in batches:
            texts, size, start = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= STEP_CHARS or i == len(batch) - 1:
                    ids = bpe.encode_many(texts)
                    counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                    columns = [batch.column(0).slice(start, len(ids)), counts, pa.array(ids, pa.binary())]
                    columns += [pa.array([bpe.decode(x) for x in ids], pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays(columns, names)
                    texts, size, start = [], 0, i + 1

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with a column decoded at the end: tokens with a space between them; null ids give null."""
    spec, at = specification(path), encoded.columns.index("ids")
    schema = encoded.withColumn("decoded", F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = parsed(spec)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(at)]
            texts = pa.array([None if x is None else bpe.decode(x) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], schema.names)

    return encoded.mapInArrow(run, schema)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = encode(documents(spark, sf_dir), decoded=True)
    return held.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
