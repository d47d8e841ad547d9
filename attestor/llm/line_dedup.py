"""Fuzzy line removal over a corpus, and the query op1.

A line is normalised to its words: A-Z lower-cased, digits to 0, ASCII punctuation to spaces. Equal normal forms are
one line. Distinct lines get a 64-bit SimHash of their distinct words; lines whose SimHashes differ in at most `flips`
bits agree in all of some `blocks - flips` blocks (pigeonhole), so the join keys are those combinations of blocks. A
SimHash of a line of ordinary length moves by more bits for one changed word, so the queries (`WHOLE`) take MinHash
bands as join keys instead, of the words of short lines and of the word pairs of longer ones, and ask of the SimHash
only what edit similarity nearly implies. A bucket's lines are confirmed against its hub by edit similarity of the
normal forms; those still apart meet in tiles of bounded size, which give out spanning links only. Linked lines form
groups, and of each group the occurrence with the smallest (doc_id, text hash, line number) stays.

Choose blocks so that a key has about as many bits as the corpus has lines in binary digits: 4 blocks and 2 flips give
6 keys of 32 bits, 5 blocks 10 keys of 38 bits. Lines with fewer than `least` words have no
fuzzy links, and lines with fewer than `exact` words are left alone: in the queries only lines without a word.

Defined cases: a null text stays null; empty texts and texts whose lines all go are left empty; rows that repeat a
doc_id and its text are one document, and each is returned; rows with one doc_id and different texts are documents of
their own; an empty table gives no rows; columns but the text pass through untouched, whatever their names, but for
columns named n_lines or n_removed, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, as_bytes, chunks, discard, documents, gram_hashes, joined, left_join_some, list_array, mix, numbered, only, signed, spread, staged, word_hashes
from .edit import similar_pairs
from .graph import bucket_components, sides, spanning, tiles


@dataclass(frozen=True)
class Lines:
    least: int = 5
    flips: int = 2
    blocks: int = 4
    percent: int = 80
    #: Words of a line from which equal normal forms are one line.
    exact: int = 5
    #: MinHash bands of 4 words and of 3 word pairs; none: SimHash blocks are the keys.
    singles: int = 0
    pairs: int = 0


PRODUCTION = Lines()
#: What op1 and the pipeline run. At edit similarity 0.8 by scattered replaced words, words have a Jaccard similarity of
#: about 2/3 and word pairs of 0.43: 1 - (1 - (2/3)**4)**14 = 0.95 and 1 - (1 - 0.43**3)**24 = 0.86 share a band at that
#: limit, most nearer ones do.
WHOLE = Lines(flips=24, exact=1, singles=14, pairs=24)
#: Lines of up to so many words have bands of words, lines of at least so many have bands of word pairs.
MOST_SINGLES, LEAST_PAIRS = 16, 12

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
_NORMAL[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_LINE_BASE = U64(0x9E3779B97F4A7C15)


def normal(line: bytes) -> str:
    return b" ".join(_NORMAL[np.frombuffer(line, np.uint8)].tobytes().split()).decode()


def line_figures(texts: list[bytes]):
    """(text, line number, words, key, simhash) of each line of the texts."""
    text, number, first, _, key, _, sim, _ = _figures(texts)
    return text, number, np.diff(first), key, sim


#: Bounds of a tile of lines that are compared in one task: by SimHash, and by edit similarity.
SKETCH_LINES, TILE_CHARS, TILE_LINES = 4096, 1_000_000, 256


def _figures(texts: list[bytes]):
    """(text, line number, first word and one more, hashes of the words, two hashes of the line, simhash, characters of
    the normal form)."""
    buf, begin = joined([*texts, b""], b"\n")
    begin = begin[:-1]
    end = np.flatnonzero(buf == 10)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    plain = _NORMAL[buf]
    words, word_ends, hashes = word_hashes(plain)
    first = np.searchsorted(words, np.append(start, len(buf)))
    n = np.diff(first)
    letters = np.concatenate(([0], np.cumsum((plain & 0xC0) != 0x80)))
    letters = np.concatenate(([0], np.cumsum(letters[word_ends] - letters[words] + 1)))
    size = np.maximum(letters[first[1:]] - letters[first[:-1]] - 1, 0)
    text = np.searchsorted(begin, start, "right") - 1
    number = np.arange(len(start)) - np.searchsorted(start, begin)[text]
    key, check, sim = (np.zeros(len(start), U64) for _ in range(3))
    has = np.flatnonzero(n)
    if len(has):
        key[has], check[has] = _sequence(hashes, first, has, n), _sequence(mix(hashes), first, has, n)
        # each word counts once in a line, or the most frequent words would make all lines alike
        of = np.repeat(np.arange(len(start), dtype=U64), n)
        once = np.sort(of << U64(40) | hashes >> U64(24))
        once = once[np.concatenate(([True], once[1:] != once[:-1]))]
        edge = np.searchsorted(once, np.append(has, len(start)).astype(U64) << U64(40))
        ones = _bit_sums(mix(once & U64((1 << 40) - 1)), edge)
        sim[has] = np.packbits(2 * ones > np.diff(edge)[:, None], axis=1, bitorder="little").view(U64)[:, 0]
    return text, number, first, hashes, key, check, sim, size


def _sequence(hashes: np.ndarray, first: np.ndarray, has: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the words of each line that has some."""
    power = np.multiply.accumulate(np.full(len(hashes) + 1, _LINE_BASE))
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(hashes * power[:-1])))
    inverse = np.multiply.accumulate(np.full(len(hashes) + 1, U64(pow(int(_LINE_BASE), -1, 1 << 64))))
    a, b = first[has], first[has + 1]
    return mix((sums[b] - sums[a]) * inverse[a] + n[has].astype(U64))


def _bit_sums(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """How often each bit is set, for the hashes from each edge to the next: bits k, k + 8, ... are counted in the bytes of
    one integer, 255 hashes at a time."""
    parts = [np.arange(a, b, 255) for a, b in zip(edge[:-1], edge[1:])] if np.diff(edge).max() > 255 else None
    starts = edge[:-1] if parts is None else np.concatenate(parts)
    out = np.empty((len(starts), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat(hashes >> U64(k) & U64(0x0101010101010101), starts)
        out[:, k::8] = lanes.view(np.uint8).reshape(-1, 8)
    return out if parts is None else np.add.reduceat(out, np.cumsum([0, *map(len, parts[:-1])]), axis=0)


_DRAWS = mix(np.arange(1, 257, dtype=U64)).astype(np.uint32) | np.uint32(1)
_SHIFTS = mix(np.arange(1001, 1257, dtype=U64)).astype(np.uint32)


def _drawn(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int, last: np.ndarray | None, base: int) -> np.ndarray:
    """MinHash band keys, one row for the hashes from each start to the next: the band's number over 40 bits. The
    hashes at `last` are left out."""
    keys, high = np.empty((len(starts), bands), U64), (hashes >> U64(32)).astype(np.uint32)
    for t in range(bands):
        key = np.full(len(starts), base + t, U64)
        for r in range(rows):
            x = high * _DRAWS[base + t * rows + r]
            x += _SHIFTS[base + t * rows + r]
            if last is not None:
                x[last] = 0xFFFFFFFF
            key = mix(key * _LINE_BASE + np.minimum.reduceat(x, starts).astype(U64))
        keys[:, t] = U64((base + t) << 40) | (key >> U64(24))
    return keys


def band_keys(first: np.ndarray, hashes: np.ndarray, p: Lines, wanted: np.ndarray) -> pa.ListArray:
    """The MinHash band keys of each wanted line; none for lines with fewer than `least` words. Without bands a wanted
    line has one empty key, as a mark."""
    n = np.diff(first)
    on = wanted & (n >= p.least)
    if not p.singles and not p.pairs:
        return list_array(pa.array(np.zeros(on.sum(), np.int64)), on.astype(np.int64))
    short, long = on & (n <= MOST_SINGLES), on & (n >= LEAST_PAIRS)
    counts = short * p.singles + long * p.pairs
    at, flat = np.cumsum(counts) - counts, np.empty(counts.sum(), U64)
    for on, bands, rows, skip in ((short, p.singles, 4, 0), (long, p.pairs, 3, short * p.singles)):
        if on.any() and bands:
            own = hashes[np.repeat(on, n)]
            ends = np.cumsum(n[on])
            pairs = on is long
            if pairs:
                own = np.append(gram_hashes(own, 2), U64(0))
            keys = _drawn(own, ends - n[on], bands, rows, ends - 1 if pairs else None, 64 if pairs else 0)
            flat[((at + skip)[on])[:, None] + np.arange(bands)] = keys
    return list_array(pa.array(signed(flat)), counts)


def _read(p: Lines) -> Callable:
    """(doc_id, of, text) -> (doc_id, of, line, key, check, sim, size, bands) of the lines with enough words: two hashes
    of their words, SimHash, characters; bands at the first of some documents' equal lines only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), as_bytes(batch.column(2))
            for a, b in chunks(texts):
                text, number, first, hashes, key, check, sim, size = _figures(texts[a:b])
                n = np.diff(first)
                fresh = np.zeros(len(key), bool)
                fresh[np.unique(key, return_index=True)[1]] = True
                columns = (ids[a:b][text], of[a:b][text], number.astype(np.int32), signed(key), signed(check), signed(sim), size.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), band_keys(first, hashes, p, fresh)], ["doc_id", "of", "line", "key", "check", "sim", "size", "bands"]
                ).filter(pa.array(n >= p.exact))

    return run


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, lines of (line, key)) -> (id, form): normal forms of the wanted lines."""
    for batch in batches:
        ids, forms = [], []
        for text, wanted in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            lines = text.split(b"\n")
            for x in wanted:
                ids.append(x["key"])
                forms.append(normal(lines[x["line"]]))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], ["id", "form"])


#: Bits of a band key, and those that are left in a number for the mark of its line.
KEY_BITS, MARK_BITS = U64(47), U64(17)


def packed(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A band key and, in the bits below it, a mark of the line, drawn anew for each key."""
    return keys << MARK_BITS | mix(ids ^ keys * _LINE_BASE) >> KEY_BITS


def shared_keys(marked: np.ndarray) -> np.ndarray:
    """The keys that stand with two marks."""
    marked = np.sort(marked)
    keys = marked >> MARK_BITS
    two = (keys[1:] == keys[:-1]) & (marked[1:] != marked[:-1])
    keys = keys[1:][two]
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _dealt(parts: int) -> Callable:
    """(key, bands) -> (part, marked): the packed band keys of many lines by part, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column(1)
            ids = np.repeat(np.asarray(batch.column(0)).view(U64), np.diff(np.asarray(bands.offsets)))
            keys = np.asarray(bands.flatten()).view(U64)
            part = (mix(keys) % U64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            marked, part = packed(keys, ids)[order], part[order]
            edge = np.flatnonzero(np.diff(part, prepend=part[:1], append=part[-1:]))
            edge = np.concatenate(([0], edge, [len(part)])) if len(part) else np.zeros(1, np.int64)
            blobs = [marked[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(part[edge[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], ["part", "marked"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, marked), sorted by part -> the keys of two lines; a part is held at a time."""
    held, now = [], None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(signed(shared_keys(np.frombuffer(b"".join(held), U64))))], ["key"])

    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != now and held:
                yield out()
                held = []
            held.append(blob)
            now = part
    if held:
        yield out()


def shared_bands(drawn: DataFrame) -> DataFrame:
    """The band keys of at least two lines, from (key, bands). Packed keys are dealt out as blocks of numbers by their
    hash, not a row each, and sorted part by part. Two lines alone with a key have one mark once in 2**17 times; there
    the key is overlooked."""
    n = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = drawn.select("key", "bands").mapInArrow(_dealt(4 * n), "part long, marked binary")
    return dealt.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_met, "key long")


def block_keys(sim: str, p: Lines):
    """The pigeonhole keys of a SimHash: its bits in each combination of blocks that `flips` changed bits must spare."""
    edges = [round(64 * i / p.blocks) for i in range(p.blocks + 1)]
    keys = []
    for t, kept in enumerate(combinations(range(p.blocks), p.blocks - p.flips)):
        mask = sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in kept)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(t), F.col(sim).bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def _verified(p: Lines) -> Callable:
    """(a, b, fa, fb) -> (a, b) of the similar forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            forms = batch.column(2).to_pylist() + batch.column(3).to_pylist()
            keep = similar_pairs(forms, np.arange(n), np.arange(n, 2 * n), p.percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _near(info: np.ndarray, size: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray, p: Lines):
    """Which pairs of lines of two tiles are of different groups and may be similar, by SimHash and size."""
    near = np.bitwise_count(info[x][:, None] ^ info[y][None, :]) <= p.flips
    near &= group[x][:, None] != group[y][None, :]
    longer = np.maximum(size[x][:, None], size[y][None, :])
    return near & (100 * np.minimum(size[x][:, None], size[y][None, :]) >= p.percent * longer)


def _hopeful(p: Lines) -> Callable:
    """Two tiles of (hub, id, c, sim, size, tile) -> the (hub, id) that may be similar to one of another group."""

    def run(table: pa.Table) -> pa.Table:
        hub, ids, group, sim, size, tile = (table.column(x).to_numpy() for x in ("hub", "id", "c", "sim", "size", "tile"))
        x, y = sides(tile)
        hit = np.zeros(len(ids), bool)
        for i in range(0, len(x), 256):
            near = _near(sim.view(U64), size.astype(np.int64), group, x[i : i + 256], y, p)
            hit[x[i : i + 256]] |= near.any(axis=1)
            hit[y] |= near.any(axis=0)
        return pa.table({"hub": hub[hit], "id": ids[hit]})

    return run


def _compare(p: Lines) -> Callable:
    """Two tiles of (hub, id, c, sim, size, hubs, form, tile) -> (a, b): links that connect all similar lines of different groups."""

    def run(table: pa.Table) -> pa.Table:
        ids, group, sim, size, tile = (table.column(x).to_numpy() for x in ("id", "c", "sim", "size", "tile"))
        forms, size = table.column("form").to_pylist(), size.astype(np.int64)
        x, y = sides(tile)
        i, j = np.nonzero(_near(sim.view(U64), size, group, x, y, p))
        i, j = x[i], y[j]
        once = i < j if len(x) and x is y else np.ones(len(i), bool)
        order = np.argsort(np.bitwise_count(sim[i[once]] ^ sim[j[once]]), kind="stable")
        i, j = i[once][order], j[once][order]
        hub, hubs = table.column("hub")[0].as_py(), [set(x) for x in table.column("hubs").to_pylist()]

        def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """A pair is decided at the first of the hubs that it has in common."""
            here = np.array([min(hubs[x] & hubs[y]) == hub for x, y in zip(a.tolist(), b.tolist())], bool)
            here[here] = similar_pairs(forms, a[here], b[here], p.percent)
            return here

        ends = spanning(group, i, j, linked)
        return pa.table({"a": ids[ends[:, 0]], "b": ids[ends[:, 1]]})

    return run


def repeated_lines(docs: DataFrame, p: Lines = PRODUCTION) -> DataFrame:
    """(doc_id, of, lines): the numbers of the lines that go from each document; of: hash of its text.

    docs: (doc_id, of, text)."""
    seen = staged(docs.mapInArrow(_read(p), "doc_id long, of long, line int, key long, check long, sim long, size int, bands array<long>"), "op1-lines")
    place = F.struct("doc_id", "of", "line")
    lines = staged(seen.groupBy("key", "check").agg(F.min(place).alias("at"), F.max(place).alias("last")), "op1-distinct")
    drawn = seen.where("size(bands) > 0")
    keys = F.col("bands") if p.singles or p.pairs else block_keys("sim", p)
    buckets = drawn.select(F.explode(keys).alias("key"), F.col("key").alias("id"), F.struct("sim", "size").alias("info"))

    form: list[DataFrame] = []  # the normal forms of all lines that may be compared, from one reading of the texts
    spent: list[DataFrame] = []  # what the answer before was made from; it is written by the time of the next question

    def ready(ids: DataFrame) -> None:
        ids = staged(ids, "op1-ids")
        wanted = only(lines, ids.withColumnRenamed("id", "key"), "key").join(ids, F.col("key") == F.col("id"))
        wanted = wanted.groupBy("at.doc_id", "at.of").agg(F.collect_list(F.struct("at.line", "key")).alias("wanted"))
        near = only(docs, wanted, "doc_id", "of").join(wanted, ["doc_id", "of"]).select("doc_id", "text", "wanted")
        form.append(staged(near.mapInArrow(_forms, "id long, form string").dropDuplicates(["id"]), "op1-forms"))
        discard(ids)

    def forms(ids: DataFrame) -> DataFrame:
        return only(form[0], ids, "id")

    def forget() -> None:
        discard(*spent)
        spent.clear()

    def verify(pairs: DataFrame) -> DataFrame:
        forget()
        alike = F.bit_count(F.col("ia.sim").bitwiseXOR(F.col("ib.sim"))) <= p.flips
        sizes = F.expr(f"100 * least(ia.size, ib.size) >= {p.percent} * greatest(ia.size, ib.size)")
        near = staged(pairs.where(alike & sizes).select("a", "b"), "op1-near")
        spent.append(near)
        both = near.join(forms(near.select(F.col("a").alias("id"))).select(F.col("id").alias("a"), F.col("form").alias("fa")), "a")
        both = both.join(forms(near.select(F.col("b").alias("id"))).select(F.col("id").alias("b"), F.col("form").alias("fb")), "b")
        return spread(both.select("a", "b", "fa", "fb")).mapInArrow(_verified(p), "a long, b long")

    def across(open_: DataFrame) -> DataFrame:
        forget()
        open_ = open_.select("hub", "id", "c", "info.sim", "info.size", "hubs")
        hopeful = spread(tiles(open_.drop("hubs"), F.lit(1), SKETCH_LINES, SKETCH_LINES), "hub", "p", "q").groupBy("hub", "p", "q").applyInArrow(_hopeful(p), "hub long, id long")
        hopeful = staged(hopeful.distinct(), "op1-hopeful")
        spent.append(hopeful)
        near = tiles(open_.join(hopeful, ["hub", "id"], "left_semi").join(forms(hopeful.select("id")), "id"), F.col("size"), TILE_CHARS, TILE_LINES)
        return spread(near, "hub", "p", "q").groupBy("hub", "p", "q").applyInArrow(_compare(p), "a long, b long")

    groups = bucket_components(buckets, verify, across, "op1", shared_bands(drawn) if p.singles or p.pairs else None, ready)
    forget()
    discard(*form)
    members = only(lines, groups.withColumnRenamed("node", "key"), "key").join(groups, F.col("key") == F.col("node"))
    keep = members.groupBy("component").agg(F.min("at").alias("keep"))
    going = members.join(keep, "component").select("key", "check", "keep")
    alone = lines.where("at < last").join(groups, F.col("key") == F.col("node"), "left_anti")
    going = staged(going.unionByName(alone.select("key", "check", F.col("at").alias("keep"))), "op1-going")
    gone = only(seen, going, "key").join(going, ["key", "check"]).where(place != F.col("keep"))
    out = staged(gone.groupBy("doc_id", "of").agg(F.collect_set("line").alias("lines")), "op1-gone")
    discard(seen, lines, going)
    return out


def dedup_lines(docs: DataFrame, p: Lines = PRODUCTION) -> DataFrame:
    """docs with the repeated lines taken out of the text, and with the columns n_lines and n_removed at the end."""
    docs = docs.select(*(F.col("text").cast("string").alias("text") if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")))
    names, at = docs.columns, docs.columns.index("text")
    one, text = F.col(f"c{names.index('doc_id')}").cast("long").alias("doc_id"), F.col(f"c{at}")
    table = numbered(docs).select("*", one, F.xxhash64(text).alias("of"))
    gone = repeated_lines(table.select("doc_id", "of", text.alias("text")), p)
    table = left_join_some(table, gone, "doc_id", "of")
    fields = numbered(docs).select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_removed = [], [], []
            for text, lines in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                parts = text.split("\n") if text is not None else []
                out = set(lines or ())
                texts.append(None if text is None else "\n".join(x for i, x in enumerate(parts) if i not in out) if out else text)
                n_lines.append(len(parts))
                n_removed.append(len(out))
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], fields.names)

    return table.select(*fields.names[:-2], "lines").mapInArrow(run, fields).toDF(*names, "n_lines", "n_removed")


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), WHOLE)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
