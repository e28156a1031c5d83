"""Registered queries of the llm operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import (
    codes,
    encoding,
    extraction,
    lines,
    middle,
    packing,
    quality,
    secrets,
    simhash,
    syncmers,
    toxicity,
    transducer,
    warc,
)
from barlake.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.round_trip(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
                           ).select("doc_id", "held_out", "score", "predicted")


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secrets.listed(of(*base)), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_worded", "n_removed", "text")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transformed(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(middle.restored(), 256).alias("restored_sha256"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.counted(table(spark, sf_dir, "documents"),
                              public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))
