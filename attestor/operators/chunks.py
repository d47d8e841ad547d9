"""Offset-preserving chunking of labels: sections of a label, blocks, table units, greedy packs and fixed windows.

Windows over tables give section offsets and fixed chunks; the order-dependent split of a section into units, which
looks at the block before and keeps a table's header with its rows, is one Arrow step over whole batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------
SEPARATOR = "\n\n"
MAX_WORDS, WINDOW_WORDS, OVERLAP = 180, 180, 30
SENTENCE_END = r"(?<=[.;:])\s+(?=[A-Z(\[•-])"
CAPTION_CHARS, CAPTION_WORD = 300, "table"
# -----------------------------------------------------------------------------------------------------------------

_BLANK = re.compile(r"\n\s*\n")
_PIECE = re.compile(SENTENCE_END)


def section_offsets(sections: DataFrame, label: str = "label_key", index: str = "section_index", text: str = "text") -> DataFrame:
    """sections with sec_start: where a section's text begins in the label's joined text."""
    w = Window.partitionBy(label).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("sec_start", F.coalesce(F.sum(F.length(text) + len(SEPARATOR)).over(w), F.lit(0)).cast("long"))


def label_document(sections: DataFrame, label: str = "label_key", index: str = "section_index", text: str = "text") -> DataFrame:
    """(label, doc): the sections' texts in order with a blank line between them."""
    held = F.array_sort(F.collect_list(F.struct(index, text)))
    return sections.groupBy(label).agg(F.array_join(F.transform(held, lambda s: s[text]), SEPARATOR).alias("doc"))


def is_table(block: Column) -> Column:
    lines = F.split(block, "\n")
    rows = F.filter(lines, lambda x: F.contains(x, F.lit(" | ")) | F.startswith(x, F.lit("| ")))
    return (F.size(lines) >= 2) & (F.size(rows) >= 2)


def blocks(text: Column) -> Column:
    """Blank-line-separated blocks of a text, in order."""
    return F.filter(F.split(text, r"\n\s*\n"), lambda b: b != "")


def pack_sizes(sizes: Column, most: int) -> Column:
    """Group number of each size when consecutive ones are packed greedily up to `most` (a larger one stays alone)."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        new = (F.size(acc["out"]) > 0) & (acc["sum"] + n > most)
        group = F.when(new, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.when(new, n).otherwise(acc["sum"] + n).alias("sum"), group.alias("group"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _line_spans(text: str, at: int) -> list[tuple[int, int]]:
    out = []
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def units(text: str, most: int) -> list[tuple[int, int, str]]:
    """(start, end, context) of the pieces that are packed: whole blocks, sentences of long blocks, table rows."""
    edges, at = [], 0
    for m in _BLANK.finditer(text):
        edges.append((at, m.start()))
        at = m.end()
    edges = [(s, e) for s, e in [*edges, (at, len(text))] if s < e]
    out: list[tuple[int, int, str]] = []
    above = ""
    for s, e in edges:
        block = text[s:e]
        spans = _line_spans(block, s)
        barred = sum(" | " in text[a:b] or text[a:b].startswith("| ") for a, b in spans)
        if len(spans) > 1 and barred > 1:
            head = spans[: 2 if len(spans) > 4 else 1]
            named = above.lstrip("- ").lower().startswith(CAPTION_WORD) and len(above) < CAPTION_CHARS
            context = "\n".join(x for x in (above if named else "", "\n".join(text[a:b] for a, b in head)) if x)
            out.append((s, head[-1][1], ""))
            out += [(a, b, context) for a, b in spans[len(head) :]]
        elif len(block.split()) > most:
            begin = s
            for m in _PIECE.finditer(block):
                out.append((begin, s + m.start(), ""))
                begin = s + m.end()
            out.append((begin, e, ""))
        else:
            out.append((s, e, ""))
        above = block
    return out


def pack(text: str, most: int) -> list[tuple[int, int, str]]:
    """(start, end, context) of the chunks of one section; a chunk's context is that of its first unit."""
    out: list[list] = []
    room = 0
    for s, e, context in units(text, most):
        n = len(text[s:e].split())
        if out and n <= room:
            out[-1][1] = e
            room -= n
        else:
            out.append([s, e, context])
            room = most - n
    return [tuple(x) for x in out]


CHUNK_FIELDS = "chunk_id string, section_index int, start int, end int, doc_start long, doc_end long, text string, context string"


def section_chunks(sections: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """Chunks that never cross a section, ids key:vN:section:n. sections: label_key, version, section_index, sec_start,
    text, and columns that are passed on. An empty section has no chunk."""
    passed = [c for c in sections.columns if c not in ("text", "sec_start")]
    schema = ", ".join(f"{c} {sections.schema[c].dataType.simpleString()}" for c in passed if c != "section_index") + ", " + CHUNK_FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for n, (s, e, context) in enumerate(pack(r["text"] or "", most)):
                    base = r["sec_start"]
                    rows.append(
                        {c: r[c] for c in passed}
                        | {"chunk_id": f"{r['label_key']}:v{r['version']}:{r['section_index']}:{n}", "start": s, "end": e, "doc_start": base + s, "doc_end": base + e, "text": r["text"][s:e], "context": context}
                    )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return sections.select(*passed, "sec_start", "text").mapInArrow(run, schema)


def fixed_windows(docs: DataFrame, key: str, text: str = "text", window: int = WINDOW_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(key, n, first, last, n_words): sliding word windows of a text, first and last word from 0. Texts without a word
    have none."""
    step = window - overlap
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    sized = docs.select(key, F.size(words).alias("total")).where("total > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("total") - overlap) - 1, F.lit(step))
    out = sized.select(key, "total", F.posexplode(starts).alias("n", "first"))
    last = F.least(F.col("first") + window, F.col("total")) - 1
    return out.select(key, "n", "first", last.alias("last"), (last - F.col("first") + 1).alias("n_words"))


def section_of(windows: DataFrame, sections: DataFrame, key: str, start: str, at: str) -> DataFrame:
    """The last section that starts at or before a place: an as-of join by label."""
    names = [c for c in sections.columns if c not in (key, start)]
    met = windows.join(sections, key).where(F.col(start) <= F.col(at))
    return met.groupBy(*windows.columns).agg(F.max_by(F.struct(*names, start), start).alias("s")).select(*windows.columns, "s.*")


_SPAN = re.compile(r"\S+")


def fixed_chunks(sections: DataFrame, window: int = WINDOW_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """Sliding word windows over whole labels: chunk_id (key:vN:fixed:n), section_index and the columns of the section in
    which the window starts, start and end in that section (the end no further than its text), doc_start and doc_end in the
    label's joined text, and text. sections: label_key, version, section_index, sec_start, text, and columns that are
    passed on. A label without a word has no chunk.

    No label is ever put together. Running sums tell each section which words of the label are its own; it gives out its
    piece of each window that reaches into it, and a window is the join of its pieces, 180 words at most."""
    passed = [c for c in sections.columns if c not in ("text", "sec_start", "section_index", "label_key", "version")]
    step, whole = window - overlap, sections.schema

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sum(1 for _ in _SPAN.finditer(t or "")) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.int64())], [*batch.schema.names[:2], "n_words"])

    sized = sections.select("label_key", "section_index", "text")
    sized = sized.mapInArrow(counts, sized.select("label_key", "section_index", F.lit(0).cast("long").alias("n_words")).schema)
    w = Window.partitionBy("label_key")
    before = F.coalesce(F.sum("n_words").over(w.orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumns({"before": before, "total": F.sum("n_words").over(w)}).where("total > 0")  # narrow rows only
    sized = sized.join(sections.select("label_key", "section_index", "sec_start", "text"), ["label_key", "section_index"])
    kind = whole["section_index"].dataType.simpleString()
    fields = f"label_key {whole['label_key'].dataType.simpleString()}, section_index {kind}, n long, piece string, doc_start long, doc_end long, starts boolean"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, section, at, text, own, first, total in zip(*(c.to_pylist() for c in batch.columns)):
                spans, text = [m.span() for m in _SPAN.finditer(text or "")], text or ""
                last_window = (max(1, total - overlap) - 1) // step
                low = max(0, -(-(first - window + 1) // step))  # the first window that reaches word `first`
                for n in range(low, last_window + 1):
                    i, j = n * step, min(n * step + window, total) - 1
                    if i >= first + own and not (own == 0 and i < first):
                        break
                    if j < first or (own == 0 and i >= first):
                        continue
                    s = spans[i - first][0] if i >= first else 0
                    e = spans[j - first][1] if j < first + own else len(text)
                    rows.append((label, section, n, text[s:e], at + s if i >= first else None, at + e if j < first + own else None, i >= first))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(fields))
    found = sized.select("label_key", "section_index", "sec_start", "text", "n_words", "before", "total").mapInArrow(pieces, fields)
    joined = found.groupBy("label_key", "n").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_index", "piece"))), lambda x: x["piece"]), SEPARATOR).alias("text"),
        F.max("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"),
        F.max(F.when(F.col("starts"), F.col("section_index"))).alias("section_index"),
    )
    held = sections.select("label_key", "version", "section_index", "sec_start", *passed, F.length("text").alias("size"))
    out = joined.join(held, ["label_key", "section_index"])
    name = F.concat_ws(":", F.col("label_key"), F.concat(F.lit("v"), F.col("version").cast("string")), F.lit("fixed"), F.col("n").cast("string"))
    return out.select(
        name.alias("chunk_id"), "label_key", "version", "n", "section_index", *passed, (F.col("doc_start") - F.col("sec_start")).alias("start"),
        F.least(F.col("doc_end") - F.col("sec_start"), F.col("size")).cast("long").alias("end"), "doc_start", "doc_end", "text",
    )
