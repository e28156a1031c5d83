"""Main text of web pages: declared articles, and what a host's pages do not share in the rest.

Every page takes part in the suffix array of its host. Its streams are the tokens outside its
article (``article``, ``main`` and the like), in one, and boxes in it. Suffixes are
sorted by host and their first ``DEPTH`` tokens; neighbours with ``DEPTH`` tokens in common form
intervals, which are the long repeated substrings. What stands behind these tokens is not
compared, as it does not change which positions such substrings cover. Content is a page's
article, or its unmarked text if it declares none: copies of a page (mirrors, query strings) are
one content and no evidence against each other.

* A page without a declared article loses what intervals of two or more contents cover, and keeps
  the rest of its unmarked blocks; menus, headers, adverts and other marked parts are evidence only.
* A page with a declared article loses those boxes of it (blocks in a ``div`` of their own) that are
  boilerplate in full: covered by substrings that boxes of two or more contents hold and that stand
  outside the article, as a menu, notice or advert does, somewhere on the host. Paragraphs, headings,
  lists and tables of an article are text even where the host repeats them, and so is a box that
  only articles share: the article must be whole.

A box can be covered in full only if its first ``DEPTH`` tokens are such a substring, so boxes
that begin with nothing that stands outside an article on the host are not sorted (``suspects``).

The array is dealt by ranges, ties by page and place, not by host, so a host may hold any
share of the pages. A task sees its own range; what it needs of the ranges before it are their
ends, one row each. Intervals are joined with places, which adaptive execution splits.

Null pages and addresses count as empty ones: no text, one common host. Every row is a page.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlake.llm.arrow import computed
from barlake.llm.html import ARTICLE, BOX, PLAIN, blocks
from barlake.session import settle, shared_folder

DEPTH = 8  # tokens that make a substring long
REST = -1  # the stream of a page that holds all outside of its article


def host(url: Column) -> Column:
    """Host of an address, lower case, without port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][^:/]*://([^/:?#]+)", 1))


def read_pages(pages: DataFrame, id: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """page_id, url, host, declared (whether it declares an article), article (its blocks), boxed (which of them are boxes), tokens
    and plain (the stream of all else, and which of its tokens are unmarked), content (hash of
    the article, or of the unmarked text), row (a number of the page); read once and stored."""

    def make():
        def compute(batch: pa.RecordBatch) -> tuple:
            declared, article, boxed, tokens, plain, content = [], [], [], [], [], []
            for page in batch.column("html").to_pylist():
                found = blocks(page, boxes=True)
                own = [t for zone, t in found if zone in (ARTICLE, BOX)]
                rest = [(w, zone == PLAIN) for zone, t in found if zone not in (ARTICLE, BOX)
                        for w in t.split(" ")]
                declared.append(bool(own))
                article.append(own)
                boxed.append([zone == BOX for zone, _ in found if zone in (ARTICLE, BOX)])
                tokens.append([w for w, _ in rest])
                plain.append([p for _, p in rest])
                content.append(xxhash.xxh64_intdigest(" ".join(
                    own or [w for w, p in rest if p])) - (1 << 63))
            return declared, article, boxed, tokens, plain, content

        return compute

    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"),
                        host(F.col(url)).alias("host"), F.col(html).alias("html"))
    read = computed(rows, ["page_id", "url", "host"], "declared boolean, article array<string>, "
                    "boxed array<boolean>, tokens array<string>, plain array<boolean>, content bigint", make)
    read = read.withColumn("row", F.monotonically_increasing_id())
    path = shared_folder(pages.sparkSession, "pages")
    read.write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(read.schema).parquet(path)


def _starts(tokens: str, depth: int) -> Column:
    """Places in the array from which ``depth`` tokens follow."""
    return F.sequence(F.lit(0), F.size(tokens) - depth)


def _run(tokens: str, at: Column | int, depth: int) -> Column:
    """The ``depth`` tokens from a place; they hold no spaces."""
    return F.array_join(F.slice(tokens, F.lit(1) + at, depth), " ")


def suspects(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, row, content, block, tokens: the boxes that begin as something outside an article
    on their host does. Starts are met by hash; a false meeting only adds a box to the array."""
    rest = pages.where(F.size("tokens") >= depth).select("host", "tokens", F.explode(
        _starts("tokens", depth)).alias("at"))
    outside = rest.select(F.xxhash64("host", _run("tokens", F.col("at"), depth)).alias("start")).distinct()
    boxes = pages.where(F.exists("boxed", lambda b: b)).select("host", "row", F.posexplode(
        F.arrays_zip("article", "boxed")).alias("block", "own")).where("own.boxed")
    own = boxes.select("host", "row", "block", F.split("own.article", " ").alias("tokens")).where(
        F.size("tokens") >= depth)
    begun = settle(own.select("row", "block", F.xxhash64("host", _run("tokens", 0, depth)).alias(
        "start")).join(outside, "start", "left_semi").select("row", "block"), "suspects")
    texts = pages.select("row", "host", "content", "article").join(begun, "row")
    return texts.select("host", "row", "content", "block", F.split(
        F.get("article", F.col("block")), " ").alias("tokens"))


def suffixes(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """host, row, content, block (of the article, or ``REST``), at, outside (whether it surely stands
    outside an article), asked (whether it may be cut) and run, the ``depth`` tokens from ``at``:
    what the array sorts."""
    long = pages.where(F.size("tokens") >= depth)
    rest = long.select("host", "row", "content", F.lit(REST).alias("block"), "tokens", "declared",
                       "plain", F.explode(_starts("tokens", depth)).alias("at"))
    marked = F.col("declared") | ~F.exists(F.slice("plain", F.col("at") + 1, depth), lambda p: p)
    own = suspects(pages, depth).select("*", F.explode(_starts("tokens", depth)).alias("at"))
    columns = ["host", "row", "content", "block", "at", "outside", "asked", _run(
        "tokens", F.col("at"), depth).alias("run")]
    return rest.withColumns({"outside": marked, "asked": ~F.col("declared")}).select(*columns).union(
        own.withColumns({"outside": F.lit(False), "asked": F.lit(True)}).select(*columns))


def suffix_array(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The suffixes in order, with place (rising with the order) and interval: the place of the first
    of all neighbours that have ``depth`` tokens of one host in common."""
    ordered = suffixes(pages, depth).orderBy("host", "run", "content", "row", "block", "at")
    # Parts of a sorted frame are ranges in order, so these numbers rise with it.
    array = settle(ordered.withColumn("place", F.monotonically_increasing_id()), "suffixes")
    array = array.withColumn("part", F.shiftright("place", 33))
    key = F.struct("host", "run")
    here = W.partitionBy("part").orderBy("place")
    before = F.lag(key).over(here)
    array = array.withColumn("_new", F.when(before.isNotNull() & (before != key), F.col("place")))
    ends = array.groupBy("part").agg(
        F.min("place").alias("_head"), F.min_by(key, "place").alias("_first"),
        F.max_by(key, "place").alias("_last"), F.max("_new").alias("_own"))
    parts = W.orderBy("part")  # one row for each part
    goes_on = F.lag("_last").over(parts) == F.col("_first")
    ends = ends.withColumn("_goes_on", F.coalesce(goes_on, F.lit(False))).withColumn(
        "_start", F.coalesce("_own", F.when(~F.col("_goes_on"), F.col("_head"))))
    carried = F.last("_start", ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1))
    ends = settle(ends.select("part", F.when(F.col("_goes_on"), carried).otherwise(
        F.col("_head")).alias("_carry")), "ends")
    own = F.last("_new", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0))
    return array.withColumn("_own", own).join(ends, "part").withColumn(
        "interval", F.coalesce("_own", "_carry")).drop("_new", "_own", "_carry", "part")


def repeated(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """row, block and gone: the places of each stream that long repeated substrings cover; streams
    outside a declared article are evidence only."""
    array = settle(suffix_array(pages, depth).drop("host", "run", "place"), "array")
    rest = F.col("block") == REST
    contents = [f(F.when(side, F.col("content"))).alias(f"{name}_{end}")
                for name, side in (("rest", rest), ("own", ~rest))
                for f, end in ((F.min, "low"), (F.max, "high"))]
    found = array.groupBy("interval").agg(*contents, F.max("outside").alias("stands_outside")).select(
        "interval", F.expr("rest_low < rest_high").alias("shared"),
        F.expr("own_low < own_high AND stands_outside").alias("inserted"))
    found = settle(found.where("shared OR inserted"), "repeats")
    hit = array.where("asked").select("interval", "row", "block", "at").join(found, "interval").where(F.when(rest, F.col("shared")).otherwise(F.col("inserted")))
    return hit.groupBy("row", "block").agg(F.array_distinct(F.flatten(F.collect_list(
        F.sequence("at", F.col("at") + depth - 1)))).alias("gone"))


def covered(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """row and gone: the stream positions of pages without an article that are boilerplate."""
    return repeated(pages, depth).where(F.col("block") == REST).select("row", "gone")


def extract(pages: DataFrame, depth: int = DEPTH, id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    read = read_pages(pages, id, url, html)
    gone = settle(repeated(read, depth), "gone")
    unique = read.where("NOT declared").join(
        gone.where(F.col("block") == REST).select("row", "gone"), "row", "left")
    kept = F.filter(F.array_except(
        F.sequence(F.lit(0), F.size("tokens")), F.array_append(
            F.coalesce("gone", F.array().cast("array<int>")), F.size("tokens"))),
        lambda i: F.get("plain", i))
    rest = unique.select("page_id", "url", F.array_join(F.transform(
        kept, lambda i: F.get("tokens", i)), " ").alias("text"))
    inserted = settle(gone.where(F.col("block") != REST).groupBy("row").agg(F.collect_list(
        F.struct("block", F.size("gone").alias("n"))).alias("gone")), "inserted")
    whole = F.filter("article", lambda text, b: ~F.exists(
        F.coalesce("gone", F.array().cast("array<struct<block:int,n:int>>")),
        lambda g: (g["block"] == b) & (g["n"] == F.size(F.split(text, " ")))))
    declared = read.where("declared").join(inserted, "row", "left").select(
        "page_id", "url", F.array_join(whole, " ").alias("text"))
    return declared.union(rest).withColumn("n_chars", F.length("text").cast("long"))
