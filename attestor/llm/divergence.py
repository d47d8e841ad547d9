"""How the sources of a language differ in their words: mergeable radix tries of terms, and the query op11.

A first pass counts documents in a hash table of fixed size, which rules out most rare terms, and none that is kept.
Then each partition counts its terms in byte tries, one a language, whose leaves have a counter for each source and one for
documents. A trie that reaches a bound is given out and begun anew, so that memory does not grow with the partition. A walk
gives its leaves in UTF-8 order; they are dealt out by ranges of the terms, and a task merges the leaves of its range from
all tries in that order. Terms in enough documents of the language are kept, in blocks. A second walk over the blocks, with the totals of the groups at hand,
adds up the divergence of each pair of sources and keeps each group's first candidates; as it goes in UTF-8 order, of
equal values the first one met wins.

All arithmetic is on integers. A source that has few of a language's terms takes part with the others' blocks all the
same, since a count of zero has a probability of its own; the work is terms x sources x sources, as is the result but for
the terms.

Defined cases: a null text has no terms; null languages and sources are the empty string; every row is a document,
repeated ids and rows too; a language without kept terms gives its pairs with value 0 and no candidates; a source alone in
its language gives no pairs; an empty table gives no rows; of equal values the smaller item by UTF-8 bytes comes first;
only text, language and source are read.
"""

from __future__ import annotations

import gc
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, documents, staged

LEAST_DOCUMENTS, TOP, SCALE = 10, 10, 1_000_000_000
#: A partition's tries are given out when they hold so many counters, or bytes of terms.
COUNTERS, TERM_BYTES = 400_000, 1 << 26
#: Terms that are counted before they enter the tries.
STEP_TERMS = 1 << 20
#: Slots of the table that tells which terms may be kept (1 MB as bits), and those that are added together.
SLOTS, SLOT_BLOCK = 1 << 23, 1 << 16
#: Kept terms of a block, and entries of a step's matrices.
BLOCK, ENTRIES = 2048, 1 << 18
#: Groups up to which their totals are broadcast, 60 bytes or so each; beyond it they are joined.
BROADCAST_GROUPS = 100_000
#: Sources of a language up to which a task adds up the pairs of all its blocks before it gives them out.
SUMMED_SOURCES = 1000

#: ASCII letters in lower case, other ASCII a space: what is left between spaces are the terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Node:
    __slots__ = ("label", "children", "counts", "docs")

    def __init__(self, label: bytes):
        self.label, self.children, self.counts, self.docs = label, {}, None, 0  # counts: of a term that ends here


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Radix trie over bytes; a leaf counts its term by source, and the documents that have it."""

    def __init__(self):
        self.root, self.counters, self.bytes = Node(b""), 0, 0

    def leaf(self, term: bytes) -> Node:
        node, at, end = self.root, 0, len(term)
        while True:
            below = node.children.get(term[at])
            if below is None:
                below = node.children[term[at]] = Node(term[at:])
                self.bytes += end - at + 64
                return below
            if not term.startswith(below.label, at):
                k = _shared(below.label, term[at:])
                upper = Node(below.label[:k])
                below.label = below.label[k:]
                upper.children[below.label[0]] = below
                node.children[upper.label[0]] = upper
                below = upper
            at += len(below.label)
            if at == end:
                return below
            node = below

    def add(self, term: bytes, counts: dict, docs: int) -> None:
        """Counts by source for a term, which are not used elsewhere: those of one batch, or of another trie's leaf."""
        leaf = self.leaf(term)
        held = leaf.counts
        leaf.docs += docs
        if held is None:
            leaf.counts = counts
            self.counters += len(counts)
            return
        for source, n in counts.items():
            if source in held:
                held[source] += n
            else:
                held[source] = n
                self.counters += 1

    def add_sorted(self, terms: list[bytes], counts: list[dict], docs: list[int]) -> None:
        """add of many terms in the order of their bytes: a term's way begins where it leaves the one before."""
        nodes, prefixes, size = [self.root], [b""], 0
        for term, own, n in zip(terms, counts, docs):
            while not term.startswith(prefixes[-1]):
                nodes.pop()
                prefixes.pop()
            node, at, end = nodes[-1], len(prefixes[-1]), len(term)
            while at < end:
                children = node.children
                below = children.get(term[at])
                if below is None:
                    below = children[term[at]] = Node(term[at:])
                    size += end - at + 64
                    at = end
                elif term.startswith(below.label, at):
                    at += len(below.label)
                else:
                    k = _shared(below.label, term[at:])
                    upper = Node(below.label[:k])
                    below.label = below.label[k:]
                    upper.children[below.label[0]] = below
                    children[term[at]] = below = upper
                    at += k
                node = below
                nodes.append(node)
                prefixes.append(term[:at])
            node.docs += n
            held = node.counts
            if held is None:
                node.counts = own
                self.counters += len(own)
                continue
            for source, c in own.items():
                if source in held:
                    held[source] += c
                else:
                    held[source] = c
                    self.counters += 1
        self.bytes += size

    def leaves(self) -> Iterator[tuple[bytes, dict, int]]:
        """(term, counts, documents) in the order of the terms' bytes."""
        todo = [(self.root, b"")]
        while todo:
            node, prefix = todo.pop()
            term = prefix + node.label
            if node.counts:
                yield term, node.counts, node.docs
            below = node.children
            if len(below) == 1:
                todo += [(x, term) for x in below.values()]
            elif below:
                todo += [(below[b], term) for b in sorted(below, reverse=True)]


LEAVES = "lang string, term string, sources array<string>, counts array<long>, docs long"


def _lists(sizes: list[int], values: list, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _leaves(lang: str, trie: Trie) -> Iterator[pa.RecordBatch]:
    terms, held, docs, size = [], [], [], 0

    def batch() -> pa.RecordBatch:
        sizes, sources, counts = list(map(len, held)), list(chain.from_iterable(held)), list(chain.from_iterable(map(dict.values, held)))
        columns = [pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
        columns += [_lists(sizes, sources, pa.string()), _lists(sizes, counts, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts", "docs"])

    for term, own, n in trie.leaves():
        terms.append(term)
        held.append(own)
        docs.append(n)
        size += len(term) + len(own) * 16
        if len(terms) == 8192 or size > 1 << 22:
            yield batch()
            terms, held, docs, size = [], [], [], 0
    if terms:
        yield batch()


def _terms(text) -> list[bytes]:
    """The terms of an Arrow string."""
    return text.as_buffer().to_pybytes().translate(_TERMS).split()


def _slots(lang: str, terms: list[bytes], n: int) -> np.ndarray:
    """In a table of n slots, a power of two."""
    start = zlib.crc32(lang.encode() + b"\0")
    return np.fromiter((zlib.crc32(t, start) for t in terms), np.int64, len(terms)) & (n - 1)


def possible(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> np.ndarray:
    """Which slots of a hash table of fixed size have enough documents: a term of a slot that has not is never kept. The
    slots of more terms than there are slots say less, but never too little.

    A task's table is 8 MB; tables are added slot block by slot block, in a stream; the driver gets a bit for each slot."""
    most = min(least, 255)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, size = np.zeros(SLOTS, np.uint32), defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if terms := _terms(text):
                    seen[lang].update(set(terms))
                    size += len(terms)
                if size >= STEP_TERMS:
                    _enter(table, seen, most)
                    size = 0
        _enter(table, seen, most)
        blocks = table.astype(np.uint8).reshape(-1, SLOT_BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([blocks[i].tobytes()])], ["block", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = -1, np.zeros(SLOT_BLOCK, np.uint16)

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= most).tobytes()])], ["block", "bits"])

        for batch in batches:
            for i, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != block:
                    if block >= 0:
                        yield given()
                    block, total = i, np.zeros(SLOT_BLOCK, np.uint16)
                total = np.minimum(total + np.frombuffer(counts.as_buffer(), np.uint8), most).astype(np.uint16)
        if block >= 0:
            yield given()

    found = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "text"))).mapInArrow(tables, "block int, counts binary")
    out = np.zeros(SLOTS, bool).reshape(-1, SLOT_BLOCK)
    for r in found.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block int, bits binary").collect():
        out[r["block"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    return out.ravel()


def _enter(table: np.ndarray, seen: dict[str, Counter], most: int) -> None:
    for lang, counter in seen.items():
        np.add.at(table, _slots(lang, list(counter), len(table)), np.minimum(np.fromiter(counter.values(), np.int64, len(counter)), most).astype(np.uint32))
    np.minimum(table, most, out=table)
    seen.clear()


def counted(docs: DataFrame, slots: np.ndarray) -> DataFrame:
    """The leaves of the partitions' tries, of terms in slots that may be kept; a term may come from many partitions."""
    bits = np.packbits(slots).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, Trie] = defaultdict(Trie)
        allowed = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)

        def enter(words: dict[str, dict[str, Counter]], seen: dict[str, Counter]) -> None:
            for lang, by_source in words.items():
                docs_with, terms = seen[lang], list(seen[lang])
                by_term: dict[bytes, dict[str, int]] = {t: {} for t, ok in zip(terms, allowed[_slots(lang, terms, len(allowed))].tolist()) if ok}
                for source, counter in by_source.items():
                    for term, n in counter.items():
                        if (own := by_term.get(term)) is not None:
                            own[source] = n
                terms = sorted(by_term)
                tries[lang].add_sorted(terms, [by_term[t] for t in terms], [docs_with[t] for t in terms])

        gc.disable()  # tries have no cycles, and their many nodes would be looked through again and again
        for batch in batches:
            langs, sources, size = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            words: dict = defaultdict(lambda: defaultdict(Counter))
            seen: dict = defaultdict(Counter)
            for i, text in enumerate(batch.column(2)):
                if terms := _terms(text):
                    words[langs[i]][sources[i]].update(terms)
                    seen[langs[i]].update(set(terms))
                    size += len(terms)
                if size >= STEP_TERMS or i == len(batch) - 1:
                    enter(words, seen)
                    words.clear(), seen.clear()
                    size = 0
                    if sum(t.counters for t in tries.values()) > COUNTERS or sum(t.bytes for t in tries.values()) > TERM_BYTES:
                        for lang in sorted(tries):
                            yield from _leaves(lang, tries[lang])
                        tries.clear()
        for lang in sorted(tries):
            yield from _leaves(lang, tries[lang])
        gc.enable()

    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return docs.mapInArrow(run, LEAVES)


BLOCKS = "lang string, terms array<string>, sizes array<int>, sources array<string>, counts array<long>"


def merged(leaves: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Blocks of terms that at least so many documents of their language have, in UTF-8 order within a task: terms, how
    many sources each has, and these sources and counts one after the other.

    The leaves of all tries come in one order, so that those of a term stand side by side: a merge adds up neighbours. It
    holds one batch, and the last term's sums until the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
            whole = _summed(rows)
            held = whole.slice(len(whole) - 1)
            yield from _blocks(whole.slice(0, len(whole) - 1), least)
        if held is not None:
            yield from _blocks(held, least)

    return leaves.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, BLOCKS)


def _summed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Leaves in order, with those of one term added up: counts by source, documents in all."""
    lang, term, sources, counts, docs = rows.columns
    new = np.ones(len(rows), bool)
    new[1:] = pc.or_(pc.not_equal(term.slice(1), term.slice(0, len(rows) - 1)), pc.not_equal(lang.slice(1), lang.slice(0, len(rows) - 1)))
    starts = np.flatnonzero(new)
    names = sources.flatten().dictionary_encode()
    leaf = np.repeat(np.cumsum(new) - 1, np.asarray(sources.value_lengths()))
    key = leaf * len(names.dictionary) + np.asarray(names.indices)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    totals = np.add.reduceat(np.asarray(counts.flatten())[order], first)
    sizes = np.bincount(leaf[order][first], minlength=len(starts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    named = names.dictionary.take(names.indices.take(pa.array(order[first])))
    at = pa.array(starts)
    columns = [lang.take(at), term.take(at), pa.ListArray.from_arrays(offsets, named), pa.ListArray.from_arrays(offsets, pa.array(totals)), pa.array(np.add.reduceat(np.asarray(docs), starts))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts", "docs"])


def _blocks(leaves: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    """The leaves with enough documents, a block for each language of the batch."""
    leaves = leaves.filter(pc.greater_equal(leaves.column(4), least))
    for lang in pc.unique(leaves.column(0)).to_pylist():
        part = leaves.filter(pc.equal(leaves.column(0), lang))
        for i in range(0, len(part), BLOCK):
            _, term, sources, counts, _ = part.slice(i, BLOCK).columns
            one = [term, sources.value_lengths(), sources.flatten(), counts.flatten()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in one]
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), *lists], ["lang", "terms", "sizes", "sources", "counts"])


def probability(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exactly: the quotient's digits three at a time."""
    rest, base = counts + 2, totals + 2 * kept
    out = np.zeros(np.broadcast(rest, base).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // base
        rest = rest % base
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); p and q are 10**9 + 1 at most."""
    return (p - q) ** 2 // (p + q)


def _totals(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each language: its sources in order with their totals of kept terms, and the number of kept terms."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*named).distinct()
    spent = blocks.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    spent = spent.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    kept = blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    lists = groups.join(spent, ["lang", "source"], "left").groupBy("lang")
    lists = lists.agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("x"))
    lists = lists.join(kept, "lang", "left")
    return lists.select("lang", F.col("x.source").alias("all_sources"), F.col("x.total").alias("totals"), F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


FOUND = "lang string, source string, part string, item string, value long"


def _figures(met: DataFrame) -> DataFrame:
    """Of blocks with their language's totals: sums of pairs (source before item) and candidates, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, list[str]] = {}
        summed: dict[str, np.ndarray] = {}
        best: dict[str, list[list[tuple[int, str]]]] = {}  # by language and source: (-value, term), in order

        def given(lang: str, part: str, rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
            same = [pa.array([x] * len(rows), pa.string()) for x in (lang, part)]
            source, item, value = ([r[i] for r in rows] for i in range(3))
            return pa.RecordBatch.from_arrays([same[0], pa.array(source, pa.string()), same[1], pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

        for batch in batches:
            for i in range(len(batch)):
                lang, terms, sizes, sources, counts, every, totals, kept = (batch.column(c)[i].as_py() for c in range(8))
                if lang not in names:
                    names[lang], best[lang] = every, [[] for _ in every]
                place = {s: k for k, s in enumerate(every)}
                total = np.array(totals, np.int64)
                n, row = len(every), np.repeat(np.arange(len(terms)), sizes)
                column, count = np.array([place[s] for s in sources], np.int64), np.array(counts, np.int64)
                pair = summed.setdefault(lang, np.zeros((n, n), np.int64)) if n <= SUMMED_SOURCES else None
                step = max(1, ENTRIES // n)
                edges = np.searchsorted(row, range(0, len(terms) + step, step))
                for b, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    part = terms[b * step : (b + 1) * step]
                    matrix = np.zeros((len(part), n), np.int64)
                    matrix[row[lo:hi] - b * step, column[lo:hi]] = count[lo:hi]
                    p = probability(matrix, total, kept)
                    q = probability(matrix.sum(axis=1), total.sum(), kept)
                    for k in range(n - 1):
                        value = distance(p[:, k : k + 1], p[:, k + 1 :]).sum(axis=0)
                        if pair is not None:
                            pair[k, k + 1 :] += value
                        else:
                            yield given(lang, "pair", list(zip([every[k]] * len(value), every[k + 1 :], value.tolist())))
                    value = np.where((matrix > 0) & (p > q[:, None]), distance(p, q[:, None]), -1)
                    for k in range(n):
                        first = best[lang][k]
                        bar = -first[TOP - 1][0] if len(first) == TOP else -1
                        new = np.flatnonzero(value[:, k] > bar)
                        if len(new):
                            new = new[np.argsort(-value[new, k], kind="stable")[:TOP]]  # in UTF-8 order among equals
                            best[lang][k] = sorted(first + [(-int(value[t, k]), part[t]) for t in new], key=lambda x: (x[0], x[1].encode()))[:TOP]
        for lang, every in names.items():
            if lang in summed:
                n = len(every)
                for k in range(n - 1):
                    yield given(lang, "pair", [(every[k], every[j], int(summed[lang][k, j])) for j in range(k + 1, n)])
            rows = [(s, term, -value) for s, first in zip(every, best[lang]) for value, term in first]
            if rows:
                yield given(lang, "term", rows)

    return met.mapInArrow(run, FOUND)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's divergence from the others of its language, and the terms that
    set it apart from the whole language."""
    leaves = staged(counted(docs, possible(docs, least)), "op11-leaves")
    blocks = staged(merged(leaves, least), "op11-blocks")
    discard(leaves)
    totals = staged(_totals(docs, blocks), "op11-totals")
    few = totals.agg(F.sum(F.size("all_sources"))).first()[0] or 0
    met = blocks.join(F.broadcast(totals) if few <= BROADCAST_GROUPS else totals, "lang")
    found = _figures(met.select("lang", "terms", "sizes", "sources", "counts", "all_sources", "totals", "kept"))
    found = staged(found, "op11-found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("lang", "value", F.explode(sides).alias("x")).select("lang", "x.source", "x.item", "value")
    bare = totals.where("kept = 0").select("lang", F.explode("all_sources").alias("source"), "all_sources")
    bare = bare.select("lang", "source", F.explode("all_sources").alias("item"), F.lit(0).cast("long").alias("value")).where("source != item")
    pairs = pairs.unionByName(bare).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                               translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
f AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c,
             1 + ({SCALE}::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(n, 0) + 2 * v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (sum(c) + 2)) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
      FROM c JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
p AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
      FROM f JOIN l USING (lang, term) WHERE c > 0 AND p > q),
u AS (SELECT * FROM p UNION ALL SELECT * FROM t)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM u QUALIFY part = 'pair' OR rank <= {TOP}
"""
