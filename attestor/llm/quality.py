"""Quality rules as a short-circuit cascade, and the query op5.

Each rule reads a few figures of a text. What a rule costs and what it rejects is measured on a sample; the rules
then run in the order of rejections per cost, each on what the ones before it have left, batch by batch. The verdict
doesn't depend on the order: a document is kept if no rule rejects it.

Defined cases: null is empty; a text without words has only zeros and fails the base rule; repeated rows each get
their row; an empty table gives no rows; only the id and the text are read for the verdict.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, U64, as_bytes, chunks, documents, gram_hashes, joined, mix, numbered, prefix_hash, span_hash, word_hashes, word_spans

SYMBOLS = b"#*$%&|<>"
#: Documents the order is estimated on (on average), and the largest share of the table they are drawn with.
SAMPLE_ROWS, SAMPLE_SHARE = 2000, 0.05

_WHITE = np.isin(np.arange(256), (0x20, 9, 10, 11, 12, 13))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


class View:
    """Figures of a chunk of texts, each computed when a rule first asks for it."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.buf, begin = joined([*texts, b""], b"\n")
        self.begin = begin[:-1]
        self._known: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_") or not hasattr(type(self), f"get_{name}"):
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = getattr(self, f"get_{name}")()
        return self._known[name]

    def total(self, mask: np.ndarray) -> np.ndarray:
        """Bytes of each text at which the mask holds."""
        return np.add.reduceat(mask.view(np.int8), self.begin[:-1], dtype=np.int64) if self.n else np.empty(0, np.int64)

    def bytes_in(self, low: int, high: int) -> np.ndarray:
        return self.total((self.buf >= low) & (self.buf <= high))

    def get_spans(self):
        return word_spans(self.buf)

    def get_first(self) -> np.ndarray:
        return np.searchsorted(self.spans[0], self.begin)

    def get_n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def get_word_chars(self) -> np.ndarray:
        return self.total(((self.buf & 0xC0) != 0x80) & ~_WHITE[self.buf])

    def get_n_symbols(self) -> np.ndarray:
        return self.total(_SYMBOL[self.buf])

    def get_upper(self) -> np.ndarray:
        return self.bytes_in(65, 90)

    def get_lower(self) -> np.ndarray:
        return self.bytes_in(97, 122)

    def get_digits(self) -> np.ndarray:
        return self.bytes_in(48, 57)

    def get_shouts(self) -> np.ndarray:
        return self.bytes_in(33, 33)

    def get_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Text number and key of each line that has a word."""
        end = np.flatnonzero(self.buf == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        words = self.spans[0]
        has = np.searchsorted(words, start) < np.searchsorted(words, end)
        start, end = start[has], end[has]
        if len(self.buf) <= 4 * CHUNK_BYTES:
            key = mix(span_hash(prefix_hash(self.buf), start, end) + (end - start).astype(U64))
        else:
            names = (hashlib.blake2b(self.buf[a:b].data, digest_size=8).digest() for a, b in zip(start, end))
            key = np.frombuffer(b"".join(names), U64)
        return np.searchsorted(self.begin, start, "right") - 1, key

    def get_n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[0], minlength=self.n)

    def get_n_dup_lines(self) -> np.ndarray:
        doc, key = self.lines
        _, at = np.unique(mix(key + doc.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
        return self.n_lines - np.bincount(doc[at], minlength=self.n)

    def get_n_repeat_words(self) -> np.ndarray:
        _, _, hashes = word_hashes(self.buf)
        n = len(hashes)
        grams = gram_hashes(hashes, 3)
        doc = np.repeat(np.arange(self.n), self.n_words)
        out = np.zeros(n, bool)
        if len(grams):
            own = np.flatnonzero(doc[: len(grams)] == doc[2:])
            key = mix(grams[own] + doc[own].astype(U64) * U64(0x9E3779B97F4A7C15))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = own[twice]
            for k in range(3):
                out[at + k] = True
        return np.bincount(doc[out], minlength=self.n)


@dataclass(frozen=True)
class Rule:
    """rejects: from a view, whether each of its texts is rejected; sql: the same condition over the figures."""

    name: str
    rejects: Callable[[View], np.ndarray]
    sql: str


BASE = (
    Rule("few_words", lambda v: v.n_words < 50, "n_words < 50"),
    Rule("repeats", lambda v: 100 * v.n_repeat_words > 50 * v.n_words, "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("symbols", lambda v: 10 * v.n_symbols > v.word_chars, "10 * n_symbols > word_chars"),
    Rule("capitals", lambda v: v.upper > v.lower, "upper > lower"),
    Rule("shouting", lambda v: 2 * v.shouts > v.n_words, "2 * shouts > n_words"),
    Rule("digits", lambda v: 2 * v.digits > v.word_chars, "2 * digits > word_chars"),
    Rule("line_repeats", lambda v: 2 * v.n_dup_lines > v.n_lines, "2 * n_dup_lines > n_lines"),
    Rule("short_words", lambda v: v.word_chars < 2 * v.n_words, "word_chars < 2 * n_words"),
    Rule("long_words", lambda v: v.word_chars > 20 * v.n_words, "word_chars > 20 * n_words"),
)
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS, share: float = SAMPLE_SHARE) -> list[dict]:
    """(rule, cost in seconds a document, share rejected) of each rule on a sample, measured where the data are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in chunks(texts):
                out = {"rule": [], "s": [], "rejected": [], "n": []}
                for i, rule in enumerate(rules):
                    began = time.thread_time()
                    rejected = rule.rejects(View(texts[a:b]))
                    out["s"].append(time.thread_time() - began)
                    out["rule"].append(i)
                    out["rejected"].append(int(rejected.sum()))
                    out["n"].append(b - a)
                yield pa.RecordBatch.from_pydict(out)

    share = min(share, rows / max(docs.count(), 1))  # a count reads no text
    sample = docs.select(F.col("text").cast("string").alias("text")).sample(fraction=share, seed=11)
    seen = sample.mapInArrow(run, "rule long, s double, rejected long, n long")
    found = {r["rule"]: r for r in seen.groupBy("rule").agg(F.sum("s").alias("s"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()}
    return [
        {"rule": rule.name, "cost": found[i]["s"] / found[i]["n"], "rejects": found[i]["rejected"] / found[i]["n"]}
        if i in found
        else {"rule": rule.name, "cost": 1.0, "rejects": 0.0}
        for i, rule in enumerate(rules)
    ]


def ordered(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **sample) -> tuple[Rule, ...]:
    """The rules by rejections per cost, the best first."""
    figures = {x["rule"]: x["rejects"] / max(x["cost"], 1e-9) for x in estimate(docs, rules, **sample)}
    return tuple(sorted(rules, key=lambda r: -figures[r.name]))


def cascade(texts: list[bytes], rules: tuple[Rule, ...]) -> list[str | None]:
    """The name of the first rule that rejects each text; each rule sees only what is left."""
    verdict: list[str | None] = [None] * len(texts)
    left = list(range(len(texts)))
    for rule in rules:
        kept = []
        for a, b in chunks([texts[i] for i in left]):
            part = left[a:b]
            for i, no in zip(part, rule.rejects(View([texts[i] for i in part]))):
                if no:
                    verdict[i] = rule.name
                else:
                    kept.append(i)
        left = kept
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """docs with a column kept_by_rules at the end: all rows and columns stay, but for one of that name; the cascade's
    verdict is added."""
    order = BASE + (ordered(docs) if rules is None else rules)
    docs = docs.select(*(docs[c] for c in docs.columns if c != "kept_by_rules"))
    names, at = docs.columns, docs.columns.index("text")
    schema = numbered(docs).select("*", F.lit(True).alias("kept_by_rules")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x is None for x in cascade(as_bytes(batch.column(at)), order)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], schema.names)

    return numbered(docs).mapInArrow(run, schema).toDF(*names, "kept_by_rules")


def figures(docs: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """(doc_id, the five figures, base_failed, kept): figures of every text, and the cascade on those that pass."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ordered(docs) if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in chunks(texts):
                view = View(texts[a:b])
                columns = [pa.array(getattr(view, x).astype(np.int64)) for x in FIGURES]
                failed = np.zeros(b - a, bool)
                for rule in BASE:
                    failed |= rule.rejects(view)
                kept = ~failed
                good = np.flatnonzero(kept)
                for i, verdict in zip(good, cascade([texts[a + i] for i in good], order)):
                    kept[i] = verdict is None
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *columns, pa.array(failed), pa.array(kept)],
                    ["doc_id", *FIGURES, "base_failed", "kept"],
                )

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in FIGURES) + ", base_failed boolean, kept boolean"
    return docs.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures(documents(spark, sf_dir))


_COUNT = "length(regexp_replace(text, '[^{0}]', '', 'g'))"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram
      FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, pos, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS twice FROM g),
c AS (SELECT doc_id, twice OR coalesce(lag(twice) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered
      FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, count(*) FILTER (covered) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
f AS (SELECT d.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             {_COUNT.format("#*$%&|<>")} AS n_symbols, len(ls) AS n_lines, len(ls) - list_unique(ls) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, {_COUNT.format("A-Z")} AS upper, {_COUNT.format("a-z")} AS lower,
             {_COUNT.format("0-9")} AS digits, {_COUNT.format("!")} AS shouts
      FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS (SELECT *, {" OR ".join(f"({x.sql})" for x in BASE)} AS base_failed, {" OR ".join(f"({x.sql})" for x in RULES)} AS rejected FROM f)
SELECT doc_id, {", ".join(f"{x}::BIGINT AS {x}" for x in FIGURES)}, base_failed, NOT base_failed AND NOT rejected AS kept FROM v
"""
