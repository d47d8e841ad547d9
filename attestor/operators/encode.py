"""Encoders of passages and queries as one Arrow stage over a table; the model is a parameter.

A model is a small frozen object that is sent with the tasks; its load() gives a function from texts to a matrix. It is
called once a worker, not once a batch. Texts of an Arrow batch are encoded in batches of about equal length; with the
default of one text a batch a row's vector depends on nothing but the row.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values ---------------------------------------------------------------------------------------------------
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
MAX_LENGTH, PAD = 512, "[PAD]"
# -----------------------------------------------------------------------------------------------------------------

Encode = Callable[[list[str]], np.ndarray]
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")
#: White space that str.split() would cut at as well.
_OTHER_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Model(Protocol):
    """Hashable, so that a worker knows whether it has loaded it."""

    dim: int

    def load(self) -> Encode: ...


class _Buckets(dict):
    """Buckets of the words met, at most so many: a lookup of a known word runs no Python."""

    def __init__(self, dim: int, most: int = 200_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = hashlib.md5(word.encode()).digest()[-1] % self.dim
        return out


@dataclass(frozen=True)
class HashModel:
    """Bags of words hashed to dim buckets (a power of two up to 256), of length 1; no model file. A text without words
    has the zero vector."""

    dim: int = 64

    def load(self) -> Encode:
        bucket = _Buckets(self.dim).__getitem__

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dim))
            for i, text in enumerate(texts):
                low = text.lower()
                words = [w for w in _BLANK.split(low) if w] if _OTHER_BLANK.search(low) else low.split()
                places = list(map(bucket, words))
                if places:
                    counts = np.bincount(places, minlength=self.dim)
                    out[i] = counts / math.sqrt(int((counts * counts).sum()))
            return out

        return encode


@dataclass(frozen=True)
class OnnxModel:
    """A sentence encoder as an ONNX graph with its tokenizer: the first token's state, of length 1.

    The files stand at the same path on every worker, or were added to the session (SparkContext.addFile). One thread and
    no spinning: tasks share a machine's cores. arena: the runtime keeps its memory for speed."""

    path: str
    tokenizer: str
    dim: int
    prefix: str = ""
    max_length: int = MAX_LENGTH
    threads: int = 1
    arena: bool = False

    def options(self):
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads, options.inter_op_num_threads = self.threads, 1
        options.execution_mode = ort.ExecutionMode.ORT_SEQUENTIAL
        options.enable_cpu_mem_arena = options.enable_mem_pattern = self.arena
        options.add_session_config_entry("session.intra_op.allow_spinning", "0")
        return options

    def load(self) -> Encode:
        import onnxruntime as ort
        from tokenizers import Tokenizer

        session = ort.InferenceSession(_found(self.path), sess_options=self.options(), providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(_found(self.tokenizer))
        tokenizer.enable_truncation(max_length=self.max_length)
        tokenizer.enable_padding(pad_id=0, pad_token=PAD)
        wanted = {i.name for i in session.get_inputs()}

        def encode(texts: list[str]) -> np.ndarray:
            found = tokenizer.encode_batch([self.prefix + t for t in texts])
            inputs = {"input_ids": [e.ids for e in found], "attention_mask": [e.attention_mask for e in found], "token_type_ids": [e.type_ids for e in found]}
            states = session.run(None, {k: np.array(v, np.int64) for k, v in inputs.items() if k in wanted})[0]
            first = states[:, 0, :].astype(np.float64)
            return first / np.maximum(np.linalg.norm(first, axis=1, keepdims=True), 1e-12)

        return encode


def _found(path: str) -> str:
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def _loaded(model: Model) -> Encode:
    return model.load()


def by_length(texts: list[str], encode: Encode, dim: int, batch: int) -> np.ndarray:
    """The texts' vectors in their order, computed in batches of the shortest first."""
    order, out = np.argsort([len(t) for t in texts], kind="stable"), np.zeros((len(texts), dim))
    for i in range(0, len(order), batch):
        part = order[i : i + batch]
        out[part] = encode([texts[k] for k in part])
    return out


def encoded(table: DataFrame, model: Model, text: str = "text", column: str = "embedding", batch: int = 1, at_once: int = 1024) -> DataFrame:
    """table with an embedding column at the end; a null text is encoded as the empty one."""
    names, place = table.columns, table.columns.index(text)
    schema = table.withColumn(column, F.array().cast("array<double>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _loaded(model)
        for rows in batches:
            for i in range(0, len(rows), at_once):
                part = rows.slice(i, at_once)
                vectors = by_length([t or "" for t in part.column(place).to_pylist()], encode, model.dim, batch)
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * model.dim)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], [*names, column])

    return table.mapInArrow(run, schema)
