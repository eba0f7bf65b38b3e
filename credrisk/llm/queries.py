"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import ann, bpe, decontaminate, language_id, line_dedup, merkle, secret_scan, simhash, spelling, suffix_dedup, token_counts, url_filter, weak_labels
from .common import ascii_lower

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@register("op1_line_dedup", line_dedup.SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20+ code points in 3+ documents stay only in the largest doc_id."""
    out = line_dedup.dedup_lines(texts(spark, sf_dir), min_chars=20, min_docs=3)
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@register("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every vec_id divisible by 100 among all others."""
    out = ann.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, k=10)
    return out.withColumnRenamed("id", "vec_id")


@register("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string that also starts in a smaller doc_id are removed."""
    out = suffix_dedup.dedup_substrings(texts(spark, sf_dir), length=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by word_bpe_49k.json; over 2,048 is marked."""
    out = token_counts.token_counts(texts(spark, sf_dir), tokenizer("word_bpe_49k.json"), limit=2048)
    return out.withColumnRenamed("id", "doc_id")


@register("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: base patterns and high-entropy strings."""
    out = secret_scan.scan_secrets(texts(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text: label-model posterior and trained score."""
    return weak_labels.quality(texts(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@register("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles, components of links at 2 or fewer differing bits."""
    out = simhash.near_duplicates(texts(spark, sf_dir), words=3, max_bits=2)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


@register("op8_decontaminate", decontaminate.SQL)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document words inside 10-word windows (or whole shorter items) of the benchmark."""
    out = decontaminate.contamination(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), span=10)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: remainder 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by cross-parsing, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(remainder(F.col("doc_id")) != 1))
    out = language_id.identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), F.coalesce(remainder(F.col("id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text by byte_bpe_50k.json, as digests."""
    return bpe.encode_digests(texts(spark, sf_dir), tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


@register("op11_spelling_variants", spelling.SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 5+ characters and 3+ occurrences, with the commoner word one edit away and the end of that chain."""
    return spelling.spelling_variants(texts(spark, sf_dir), min_chars=5, min_count=3, slip=97)


@register("op12_merkle_manifest", merkle.SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; every fifth or so is checked with a lower-cased text."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle.manifest(table(spark, sf_dir, "documents").select(*columns), columns,
                          tampered={"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))})
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"),
                      "folded_root", "verified")


@register("op13_url_filter", url_filter.SQL)
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule, template and verdict of every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).withColumnRenamed("id", "page_id")
