"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half the radius of both.
So every distinct fingerprint emits all variants within ``radius // 2`` bits (65 for a radius
of 2), variants are shuffled, and fingerprints that meet are verified. The members of one
variant are at most ``1 + 64`` fingerprints, all within the radius of each other, so linking
each to the next in order keeps every component, without all pairs. Copies share a fingerprint
and are carried as one row.

Fingerprints: words are runs of characters other than space and U+0009 to U+000D, after
lowering A to Z; shingles are three words joined by spaces, repeats included (a shorter text
is one shingle; no words, a null text included, give fingerprint zero). A bit is set where more than half of
the shingles' XXH64 (seed 42) have it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.llm.arrow import computed
from barlake.llm.components import roots
from barlake.session import settle

WORDS = 3
SEED = 42
BITS = 64
RADIUS = 2
CHUNK = 1 << 17  # shingles counted at a time


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxhash.xxh64_intdigest(b" ".join(w), seed)
    n = len(w) - words + 1
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        part = w[k:min(k + CHUNK, n) + words - 1]
        shingles = zip(*(part[i:] for i in range(words)))
        h = np.array([digest(b" ".join(s), seed) for s in shingles], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """doc_id and fp (BIGINT with the fingerprint's bits)."""

    def make():
        return lambda batch: (np.array([fingerprint(t, words, seed) for t in batch.column(
            "text").to_pylist()], dtype=np.uint64).view(np.int64),)

    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return computed(rows, ["doc_id"], "fp bigint", make)


def masks(radius: int) -> list[int]:
    """All signed 64-bit masks with at most ``radius`` bits."""
    out = []
    for k in range(radius + 1):
        for bits in combinations(range(BITS), k):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: verified links between distinct fingerprints (column fp) that keep the components
    of all links within ``radius`` bits. ``radius`` must be even: then all fingerprints that
    share a variant are within it."""
    if radius % 2 or radius < 0:
        raise ValueError("an even radius is needed")
    emitted = distinct.select("fp", F.explode(F.transform(
        F.lit(masks(radius // 2)), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(W.partitionBy("variant").orderBy("fp"))
    met = emitted.select("fp", before.alias("before")).where(F.col("before").isNotNull())
    return met.select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct().where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, seed: int = SEED,
               id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id that
    links reach, its own included).

    Rows with a null id take part in links and get a component; it is null only if all ids of
    the component are. Equal rows give equal rows; an empty table gives an empty one.
    """
    own = settle(fingerprints(docs, words, seed, id, text), "fingerprints")
    distinct = settle(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    root = settle(roots(links(distinct, radius)), "roots")
    placed = settle(distinct.join(root, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    named = settle(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    by_fp = settle(placed.join(named, "root").select("fp", "component_id"), "components")
    return own.join(by_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, words: int = WORDS,
                id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one of each component kept: that with the smallest id.
    Rows with equal ids are one document; rows with a null id stay."""
    gone = components(docs, radius, words, id=id, text=text).where(
        "doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id] == gone["_gone"], "left_anti")
