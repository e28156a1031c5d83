"""Document fingerprints by closed syncmers, with DataFrame functions only.

A text is a run of words. Of every ``K`` words in a row, the run is an anchor if its smallest
inner run of ``S`` words, by hash, stands at one of its edges. Whether a run is one depends on
its own words alone, so an edit elsewhere never moves an anchor, and equal passages have equal
anchors wherever they stand. Ties count for the edge.

The anchors with their positions serve to match passages. Likeness is read from all distinct
anchors of both texts. A document's result has a digest of all its anchors with their positions,
and beside it a sketch of bounded size, the ``KEPT`` smallest distinct anchor hashes.

Words are split at space and U+0009 to U+000D. A text with fewer than ``K`` words but at least
one has a single anchor, all of it; one without words, a null text included, has an empty fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.session import settle

K, S = 4, 2
KEPT = 64
SLICE = 256  # neighbouring ids that are ordered together
SPACES = "[\\x20\\x09-\\x0D]+"


def _marked(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the columns from which anchors are read: hashes of words and of inner runs."""
    words = F.transform(F.array_remove(F.split(F.col(text), SPACES), ""),
                        lambda w: F.xxhash64(w))
    rows = rows.withColumn(f"{name}_w", words)
    runs = F.transform(F.when(F.size(f"{name}_w") >= S, F.sequence(
        F.lit(0), F.size(f"{name}_w") - S)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(f"{name}_w", i + j) for j in range(S)]))
    rows = rows.withColumn(f"{name}_s", runs)
    inner = K - S + 1

    def at_edge(i: Column) -> Column:
        s = [F.get(f"{name}_s", i + j) for j in range(inner)]
        middle = F.least(*s[1:-1]) if inner > 3 else s[1]
        return F.least(s[0], s[-1]) <= middle

    n = F.size(f"{name}_w")
    return rows.withColumn(f"{name}_at", F.when(n >= K, F.filter(F.sequence(
        F.lit(0), n - K), at_edge)).when(n > 0, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>")))


def _hash(name: str, i: Column) -> Column:
    """Hash of the K words from i on; words past the end of a short text count as none."""
    return F.xxhash64(*[F.get(f"{name}_w", i + j) for j in range(K)])


def anchors(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, position (word number) and anchor (hash), for positional matching."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return _marked(rows, "t", "a").select("doc_id", F.inline(F.transform("a_at", lambda i: F.struct(
        i.alias("position"), _hash("a", i).alias("anchor")))))


def fingerprinted(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: all distinct anchor hashes of the text, sorted, and ``name_digest``: SHA-256
    of all anchors with their positions."""
    marked = _marked(rows, text, name).withColumn(f"{name}_h", F.transform(
        f"{name}_at", lambda i: _hash(name, i)))
    placed = F.zip_with(f"{name}_at", f"{name}_h", lambda i, h: F.concat_ws(
        ":", i.cast("string"), F.hex(h)))
    return marked.withColumn(name, F.sort_array(F.array_distinct(f"{name}_h"))).withColumn(
        f"{name}_digest", F.sha2(F.array_join(placed, ","), 256)).drop(
        f"{name}_w", f"{name}_s", f"{name}_at", f"{name}_h")


def digits(anchors: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each of the ``KEPT`` smallest hashes."""
    return F.array_join(F.transform(F.slice(anchors, 1, KEPT),
                                    lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of anchors in common (twice those in both, over those of both), of all distinct
    anchors; 1 for two empty fingerprints, 0 for one."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(
        2 * both / (F.size(a) + F.size(b)))


def _slices_in_order(slices: DataFrame, width: int) -> DataFrame:
    """_slice, next_slice: the next lower slice that has rows; the highest after the lowest.

    Slices are ordered inside slices of slices, and only those, ``width ** 2`` times fewer than
    rows, are ordered in one place.
    """
    slices = slices.select("_slice", F.floor(F.col("_slice") / width).alias("_block"))
    down = F.col("_slice").desc()
    inside = slices.withColumn("next_slice", F.lead("_slice").over(
        W.partitionBy("_block").orderBy(down)))
    heads = slices.groupBy("_block").agg(F.max("_slice").alias("_head"))
    blocks = W.orderBy(F.col("_block").desc())
    after = heads.select("_block", F.coalesce(
        F.lead("_head").over(blocks), F.first("_head").over(blocks)).alias("_after"))
    return inside.join(after, "_block").select(
        "_slice", F.coalesce("next_slice", "_after").alias("next_slice"))


def edited(docs: DataFrame, id: str = "doc_id", text: str = "text",
           per_slice: int = SLICE) -> DataFrame:
    """doc_id, n_chars, edited (text), and the anchors kept, next_kept, edited_kept, with digests.

    The edited text is the document with its last half (rounded down) replaced by as many
    first code points of the next document by descending id, or all it has; the first document
    comes after the last. Rows with equal ids follow by the hash of their text, null ids come
    last. Documents are ordered inside slices of neighbouring ids, about ``per_slice`` each;
    the first document of each slice, found before the shuffle, serves the slice above it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    low, high, n = docs.agg(F.min(id), F.max(id), F.count(id)).first()
    width = max(1, per_slice * (high - low + 1) // n) if n else 1
    slices = F.coalesce(F.floor(F.col(id) / width), F.lit(-(1 << 62)).cast("bigint"))
    rows = docs.select(F.col(id).alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("tie"),
                       slices.alias("_slice"))
    w = W.partitionBy("_slice").orderBy(F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    heads = settle(rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(
        "_slice", "t"), "heads")
    order = _slices_in_order(heads, per_slice)
    after = settle(order.join(heads.select(
        F.col("_slice").alias("next_slice"), F.col("t").alias("head")), "next_slice").select(
        "_slice", "head"), "after")
    inside = rows.withColumn("_lead", F.lead(F.struct("t")).over(w))
    both = inside.join(after, "_slice").select(
        "doc_id", "t", F.coalesce("_lead.t", "head").alias("next_t"), F.length("t").alias("n"))
    half = F.floor(F.col("n") / 2).cast("int")
    # Anchors are read after the shuffle, which moves texts only.
    made = both.select("doc_id", F.col("n").cast("long").alias("n_chars"), "t", "next_t",
                       F.concat(F.substring("t", F.lit(1), F.col("n") - half), F.substring(
                           "next_t", F.lit(1), half)).alias("edited"))
    for column, name in (("t", "kept"), ("next_t", "next_kept"), ("edited", "edited_kept")):
        made = fingerprinted(made, column, name)
    return made.drop("t", "next_t")


def compared(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, anchors_sha256, edited_anchors_sha256 (of all anchors with positions)."""
    return edited(docs, id, text).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        digits(F.col("kept")).alias("fingerprint"),
        digits(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness("kept", "edited_kept").alias("near_edited"),
        likeness("kept", "next_kept").alias("near_next"),
        F.col("kept_digest").alias("anchors_sha256"),
        F.col("edited_kept_digest").alias("edited_anchors_sha256"))
