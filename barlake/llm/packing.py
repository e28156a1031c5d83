"""Concatenate-and-cut packing of documents into fixed windows of tokens.

All documents' tokens, each followed by a separator, form one long line that is cut every
``size`` tokens; only the last window is short. No task sees the line. Pass one tokenizes each
input partition once and stores its documents with their offset in the partition. The
partitions' token totals (one row each) give every partition its place in the line by a prefix
sum. Pass two cuts each document at the window borders. A window that reaches over the end of
a partition simply gets pieces from both sides, as offsets are global.

The line runs in the order of the stored partitions. Null texts count as empty: one piece with
the separator alone. A document longer than a window gives as many pieces as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.arrow import computed
from barlake.llm.words import library_codec
from barlake.session import shared_folder

WINDOW = 1024
SEPARATOR = 0
PIECES = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def tokenized(docs: DataFrame, vocabulary: str, separator: int = SEPARATOR, id: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Pass one: doc_id, part, at (offset in the partition), n, ids (packed unsigned integers
    of 16 bits if the vocabulary fits them, else 32), stored in the shared folder."""

    def make():
        c = library_codec(vocabulary)
        end = np.array([separator], dtype="<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0

        def compute(batch: pa.RecordBatch) -> tuple:
            nonlocal at
            ids = [np.frombuffer(x + end, "<u4") for x in c.encode_all(batch.column("text").to_pylist())]
            n = np.array([len(x) for x in ids], dtype=np.int64)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            return np.full(len(n), part, np.int64), before, n, [x.astype(c.width).tobytes() for x in ids]

        return compute

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    out = computed(rows, ["doc_id"], "part bigint, at bigint, n bigint, ids binary", make)
    path = shared_folder(docs.sparkSession, "packing")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def pack(docs: DataFrame, vocabulary: str, size: int = WINDOW, separator: int = SEPARATOR,
         id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (the document's tokens before it), length, ids_crc32
    (of little-endian unsigned 32-bit ids), doc_tokens, sequence_id and offset in it."""
    stored = tokenized(docs, vocabulary, separator, id, text)
    # One row per input partition, so the window and the broadcast hold a few bytes for every
    # hundred or so megabytes of text.
    starts = (stored.groupBy("part").agg(F.sum("n").alias("total"))
              .select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total"))
                      .alias("before")))
    placed = stored.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("at"), "n", "ids")

    names = [f.name for f in T._parse_datatype_string(PIECES).fields]
    schema = T.StructType([placed.schema["doc_id"], *T._parse_datatype_string(PIECES).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at_, n_, ids_ = [], *(batch.column(c).to_pylist() for c in ("at", "n", "ids"))
            for row, (at, n, ids) in enumerate(zip(at_, n_, ids_, strict=True)):
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                first = 0
                while first < n:
                    sequence, offset = divmod(at + first, size)
                    length = min(size - offset, n - first)
                    rows.append((row, first, length, zlib.crc32(ids[first:first + length]), n, sequence, offset))
                    first += length
            columns = np.array(rows, dtype=np.int64).reshape(-1, 7).T
            # Ids are taken as they are, by row, so nulls and large ones stay exact.
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(columns[0])), *[
                pa.array(c) for c in columns[1:]]], ["doc_id", *names])

    return placed.mapInArrow(cut, schema)
