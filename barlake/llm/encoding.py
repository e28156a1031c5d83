"""Token ids of documents and back, as DataFrame operators over ``bpe``.

Null texts count as empty: no tokens, an empty decoded text. Row order, ids and repeats do not
matter; every input row gives one output row. Work is one pass without a shuffle; a worker
holds one Arrow batch of texts, one vocabulary and a bounded dictionary of words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.arrow import computed
from barlake.llm.bpe import codec


def encode(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, the tokens as ARRAY<INT>."""

    def make():
        c = codec(vocabulary)
        return lambda batch: ([np.frombuffer(c.encode(t or ""), "<u4").astype(np.int32)
                               for t in batch.column("text").to_pylist()],)

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return computed(rows, ["doc_id"], "ids array<int>", make)


def decode(tokens: DataFrame, vocabulary: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text, the tokens' text with special tokens kept; null ids give ''."""

    def make():
        c = codec(vocabulary)
        return lambda batch: ([c.decoder.decode(np.asarray(i or [], dtype=np.int64)).decode()
                               for i in batch.column("ids").to_pylist()],)

    rows = tokens.select(F.col(id).alias("doc_id"), F.col(ids).alias("ids"))
    return computed(rows, ["doc_id"], "text string", make)


def round_trip(docs: DataFrame, vocabulary: str, id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the text
    that they decode to. Encodes and decodes in one pass, so neither ids nor decoded texts
    leave the worker."""

    def make():
        c = codec(vocabulary)

        def compute(batch: pa.RecordBatch) -> tuple:
            rows = []
            for t in batch.column("text").to_pylist():
                ids = c.encode(t or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                             hashlib.sha256(c.decode(ids)).hexdigest()))
            return tuple(zip(*rows, strict=True)) if rows else ([], [], [])

        return compute

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return computed(rows, ["doc_id"], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
