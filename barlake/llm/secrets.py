"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob, named by its SHA-256. The ledger is a table of findings, a
row for each (blob, rule version) scanned so far, whether anything was found or not. A scan
names all paths' blobs, scans only those that the ledger lacks at this rule version, appends
them, and joins findings back to all paths. Copies, unchanged versions and repeated runs cost
a digest.

Blobs are deduplicated by a pre-aggregated grouping, so a group of copies of any size moves as
one text per task. The ledger is a stored table: its join with the paths of a frequent blob is
split by adaptive execution. Null texts count as empty blobs; every row gets a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.session import shared_folder

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()),
                       T.StructField("rules", T.StringType()),
                       T.StructField("spans", T.ArrayType(SPAN))])


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group must have; shorter matches are dropped


@dataclass(frozen=True)
class Rules:
    """Rules in the order in which spans that start together are listed."""

    version: str
    rules: tuple[Rule, ...]

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, leftmost and without overlap in each kind."""
        found = [(m.start(), n, m.end()) for n, r in enumerate(self.rules)
                 for m in re.finditer(r.pattern, text)
                 if m.end(r.group) - m.start(r.group) >= r.least]
        return [(self.rules[n].kind, start, end) for start, n, end in sorted(found)]


BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                   r"([A-Za-z0-9+/_.=-]+)", 2, 6),
    # A run is taken from its start to its end, so a lower bound in the pattern drops the same
    # runs as a later test of its length.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = Rules("2", BASE + (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("signed", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ledger(spark, folder: str) -> DataFrame:
    """The ledger kept in a folder; an empty one where nothing was scanned yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan_new(docs: DataFrame, folder: str, rules: Rules = RULES, text: str = "text") -> None:
    """Scan the blobs that the ledger lacks at this rule version, and append them to it."""
    spark = docs.sparkSession
    blobs = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        blob_of(F.col("text")).alias("blob"), "text").groupBy("blob").agg(
        F.first("text").alias("text"))
    seen = ledger(spark, folder).where(F.col("rules") == rules.version).select("blob")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"blob": pdf["blob"], "rules": rules.version, "spans": [
                [{"kind": k, "start": s, "end": e} for k, s, e in rules.scan(t)]
                for t in pdf["text"]]})

    blobs.join(seen, "blob", "left_anti").mapInPandas(run, LEDGER).write.mode(
        "append").parquet(folder)


def scan(docs: DataFrame, folder: str | None = None, rules: Rules = RULES, id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """doc_id, blob and spans of every row, through the ledger in ``folder`` (a new one below
    the shared folder if none is named)."""
    folder = folder or shared_folder(docs.sparkSession, "ledger")
    scan_new(docs, folder, rules, text)
    paths = docs.select(F.col(id).alias("doc_id"), blob_of(F.col(text)).alias("blob"))
    found = ledger(docs.sparkSession, folder).where(F.col("rules") == rules.version).select(
        "blob", "spans")
    return paths.join(found, "blob").select("doc_id", "blob", "spans")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Rules = RULES, mark: str = "[secret]", id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """The documents, all columns, with every span of the text replaced by ``mark``; spans that
    overlap are replaced together. Null texts stay null."""
    folder = shared_folder(docs.sparkSession, "ledger")
    scan_new(docs, folder, rules, text)
    # The ledger without its empty rows is short; the texts are joined with it by their blob.
    found = ledger(docs.sparkSession, folder).where(
        (F.col("rules") == rules.version) & (F.size("spans") > 0)).select(
        F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    # Only texts with findings are rewritten: cut at the merged borders of the spans.
    merged = F.aggregate("_spans", F.array().cast("array<struct<start:bigint,end:bigint>>"),
                         lambda done, s: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["start"].alias("start"),
            F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(
        F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    both = docs.select(
        F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"),
        blob_of(F.col(text)).alias("_own")).join(
        found, F.col("_own") == F.col("_blob"), "left").withColumn("_cuts", merged)
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("_cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.length("_text").cast(
        "bigint")))
    parts = F.zip_with(starts, ends, lambda s, e: F.substring(
        F.col("_text"), (s + 1).cast("int"), (e - s).cast("int")))
    clean = F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(F.array_join(parts, mark))
    return both.select(*[clean.alias(c) if c == text else F.col("_row")[c].alias(c)
                         for c in docs.columns])
