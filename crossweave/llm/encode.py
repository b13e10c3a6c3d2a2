"""Encoding of a whole corpus with a public tokenizer (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from crossweave.llm.bpe import transducer

#: Where the vocabulary files are; every executor reads them there.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """Path of a rank file."""
    return f"{folder}/{name}.tiktoken"


def encode(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids ARRAY<INT>) for every row: the ids of the whole text, an empty list for an empty or null one. A row-wise
    Arrow map without a shuffle; the vocabulary is read once a worker."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            ids = pa.array([machine.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """(*keep, n_tokens) for every row; only the counts leave the workers."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            n = pa.array([len(machine.encode(t)) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), n], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, text).mapInArrow(run, f"{kinds}, n_tokens long")


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of encoded rows; null ids give a null text, no ids an empty one."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            texts = pa.array([None if x is None else machine.decode(x) for x in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")
