"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, decontamination, BPE round trip.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``documents``.  ``run`` writes every
stage's rows as Parquet into the shared folder and reads them back as the next
stage's docs.

Edge cases: null texts and texts without letters go in the first stage; empty tables pass all
stages; rows that share a ``doc_id`` get one decision; a null id is no group's smallest and stays; very
long texts are read whole by every stage; further columns are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credrisk.llm import bpe, decontaminate, language_id, line_dedup, simhash
from credrisk.llm.common import materialise
from credrisk.llm.queries import remainder, tokenizer
from credrisk.sources.tables import table


def with_text(docs: DataFrame, text) -> list:
    """The columns of ``docs`` with ``text`` replaced and ``n_chars`` following it."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without letters go.

    Learns from the labelled documents that ``op9`` may learn from.
    """
    model = language_id.fit(docs.where(remainder(F.col("doc_id")) != 1))
    judged = language_id.identify(docs.select(F.struct(*docs.columns).alias("doc")), model, id_col="doc", text_col="doc.text")
    return judged.where(F.col("lang_pred") != language_id.UNDETERMINED).select("id.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents share (kept in the largest id)."""
    return line_dedup.dedup_lines(docs).select(*with_text(docs, F.col("kept_text")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    groups = simhash.near_duplicates(docs.select("doc_id", "text"), words=3, max_bits=2)
    gone = groups.where(F.col("id") != F.col("component")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 10-word window of the benchmark."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), span=10)
    dirty = found.where("n_hit > 0").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(dirty, "doc_id", "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of the ids and of the text decoded from them."""
    return bpe.encode_digests(docs, tokenizer("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Language ID, fingerprints and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every intermediate result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
