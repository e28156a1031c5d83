"""Product-quantisation codes of integer vectors, with nearest entries found through grid cells.

Vectors are scaled and floored to integers and cut into ``parts`` equal parts. Each part has a
codebook of at most ``entries`` rows, refined by rounds of exact assignment and floored means.

Nearest entry: space is cut into cells of ``WIDTH`` units. Of a cell's box, every entry has a least
and a greatest distance; an entry whose least distance is above the smallest greatest one of all
is dominated across the box. The others are kept by the cell's coordinates, and only they are
compared exactly with the vectors of the cell. Balls around boxes, a matrix product, leave few
entries for the bounds of the boxes themselves. All distances are whole numbers.

Rows whose vector is null or holds null or non-finite components are dropped. Repeated rows stay;
the first entries are those of the smallest ids (of equal ids the smaller vector first, null ids
last). Fewer rows than entries give smaller codebooks. A null label is a label. Vectors must be of
one length that ``parts`` divides, with scaled components below 2^22 in size (so that every
distance is exact); others stop the job with a message. An empty table gives an empty one.

Scaled vectors are stored once. Each round is one pass that sums in every task and shuffles at
most one row per entry, part and task; codebooks (parts x entries rows, whatever the input) are
all that comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.llm.arrow import computed
from barlake.session import settle

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
WIDTH = 16  # side of a cell
CACHED = 150_000  # cells kept per part before the dictionary starts anew
FAN_IN = 32  # partitions whose smallest rows meet in one task
LARGEST = 1 << 22


class Cells:
    """Exact nearest entries of one codebook (entries x components, integers)."""

    def __init__(self, book: np.ndarray, width: int = WIDTH):
        self.book, self.width = book, width
        self.real = book.astype(np.float64)
        self.squares = (self.real ** 2).sum(axis=1)
        self.known: dict[bytes, np.ndarray] = {}

    def learn(self, cells: np.ndarray, keys: Sequence[bytes]) -> None:
        """Entries that are not dominated across the boxes of new cells."""
        half = (self.width - 1) / 2
        low = cells * self.width
        middle = low + half
        square = (middle ** 2).sum(axis=1)[:, None] + self.squares - 2 * middle @ self.real.T
        distance = np.sqrt(np.maximum(square, 0))
        radius = half * np.sqrt(cells.shape[1])
        near = distance - radius <= distance.min(axis=1, keepdims=True) + radius + 1e-6
        at, entry = np.nonzero(near)
        off = np.abs(self.real[entry] - middle[at])
        least = (np.maximum(off - half, 0) ** 2).sum(axis=1)
        greatest = ((off + half) ** 2).sum(axis=1)
        first = np.searchsorted(at, np.arange(len(cells)))
        bound = np.minimum.reduceat(greatest, first)
        kept = least <= bound[at]
        at, entry = at[kept], entry[kept]
        for key, few in zip(keys, np.split(entry, np.searchsorted(at, np.arange(1, len(cells)))),
                            strict=True):
            self.known[key] = few

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equals, and its squared distance."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells = np.floor_divide(x, self.width)
        keys = np.ascontiguousarray(cells).view(f"V{8 * x.shape[1]}").ravel().tolist()
        if len(self.known) > CACHED:
            self.known = {}
        new = {k: i for i, k in enumerate(keys) if k not in self.known}
        if new:
            self.learn(cells[list(new.values())], list(new))
        few = [self.known[k] for k in keys]
        sizes = np.array([len(f) for f in few])
        entry, row = np.concatenate(few), np.repeat(np.arange(len(x)), sizes)
        off = x[row] - self.book[entry]
        distance = np.einsum("ij,ij->i", off, off)
        least = np.minimum.reduceat(distance, np.cumsum(sizes) - sizes)
        hit = np.flatnonzero(distance == least[row])
        _, lowest = np.unique(row[hit], return_index=True)
        return entry[hit[lowest]], least


def scaled(vectors: DataFrame, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding",
           label: str = "label") -> DataFrame:
    """vec_id, label and v, the floored components, of the rows that are kept."""
    v = F.col("v")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(
        F.col(id).alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("v")).where(fine).withColumn(
        "v", F.transform(v, lambda x: F.floor(x * scale).cast("bigint")))


def smallest(rows: DataFrame, n: int) -> list[list[int]]:
    """The first ``n`` vectors by id. Tasks hand on ``n`` rows each, ``FAN_IN`` tasks at a time."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    groups = rows.rdd.getNumPartitions()
    left = rows.select("vec_id", "v", F.spark_partition_id().alias("g"))
    while groups > FAN_IN:
        groups = -(-groups // FAN_IN)
        left = left.withColumn("g", F.col("g") % groups)
        left = left.withColumn("_n", F.row_number().over(W.partitionBy("g").orderBy(*order))).where(
            F.col("_n") <= n).drop("_n")
    return [r.v for r in left.orderBy(*order).limit(n).select("v").collect()]


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("v")
    lengths = column.value_lengths().to_numpy()
    if len(lengths) and (lengths != width).any():
        raise ValueError(f"vectors of other lengths than {width}")
    x = column.flatten().to_numpy().astype(np.int64, copy=False).reshape(len(lengths), width)
    if x.size and max(-x.min(), x.max()) >= LARGEST:
        raise ValueError(f"scaled components of {LARGEST} and more")
    return x


def _assigned(x: np.ndarray, searches: Sequence[Cells]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [s.nearest(p) for s, p in zip(searches, np.hsplit(x, len(searches)), strict=True)]


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts x entries x components) after one round: floored means of the parts
    assigned to each entry; entries without parts stay."""
    parts, entries, width = books.shape

    def run(batches):
        searches = [Cells(b) for b in books]
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch, parts * width)
            for p, (entry, _) in enumerate(_assigned(x, searches)):
                own = np.column_stack([x[:, p * width:(p + 1) * width], np.ones(len(x), np.int64)])
                np.add.at(sums[p], entry, own)
        part, entry = np.nonzero(sums[:, :, width])
        yield pa.RecordBatch.from_arrays([
            pa.array(part * entries + entry, pa.int64()),
            pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["at", "s"])

    each = rows.select("v").mapInArrow(run, "at bigint, s array<bigint>")
    total = each.groupBy("at").agg(*[
        F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width + 1)])
    out = books.copy().reshape(parts * entries, width)
    for r in total.collect():  # at most parts x entries rows
        out[r["at"]] = [r[f"s{i}"] // r[f"s{width}"] for i in range(width)]
    return out.reshape(books.shape)


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
              rounds: int = ROUNDS) -> np.ndarray | None:
    """Final codebooks of stored scaled rows; none for an empty table."""
    vectors = smallest(rows, entries)
    if not vectors:
        return None
    if len(set(map(len, vectors))) > 1:
        raise ValueError(f"vectors of other lengths than {len(vectors[0])}")
    first = np.array(vectors, dtype=np.int64)
    if first.shape[1] % parts or not first.shape[1]:
        raise ValueError(f"{parts} equal parts of {first.shape[1]} components")
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refined(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (entry of each part) and error, the squared distances summed."""
    parts, _, width = books.shape

    def make():
        searches = [Cells(b) for b in books]

        def compute(batch: pa.RecordBatch) -> tuple:
            found = _assigned(_matrix(batch, parts * width), searches)
            codes = np.column_stack([e for e, _ in found])
            return list(codes), np.sum([d for _, d in found], axis=0)

        return compute

    return computed(rows, ["vec_id", "label"], "codes array<bigint>, error bigint", make)


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
               scale: int = SCALE, id: str = "vec_id", vector: str = "embedding",
               label: str = "label") -> DataFrame:
    """vec_id, code (two lowercase hex digits for each part), error, label_error (summed over equal
    labels) and codebooks_sha256, of every kept row. At most 256 entries."""
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    rows = settle(scaled(vectors, scale, id, vector, label), "vectors")
    books = codebooks(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"),
                           F.lit(0).cast("bigint").alias("label_error"),
                           F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = settle(encoded(rows, books), "codes")
    by_label = out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    two = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return out.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.array_join(two, "").alias("code"), "error", "label_error",
        F.lit(digest).alias("codebooks_sha256"))
