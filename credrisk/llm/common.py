"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, computes the plan once, and leaves a
    columnar table that later steps prune.  The folder is the one that
    ``spark.checkpoint.dir`` names, shared by the driver and all executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` is exact (and fast) on pure ASCII;
    other strings go through ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def hash_pair(prefix: str, value: Column) -> list[Column]:
    """Two differently seeded 64-bit hashes: a 128-bit identity for grouping."""
    return [F.xxhash64(value).alias(f"{prefix}1"), F.xxhash64(F.lit(prefix), value).alias(f"{prefix}2")]


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned CRC-32 of an ASCII or UTF-8 string: eight shifts a byte."""
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    step = f"list_reduce(range(8), lambda a, b: {bit.format('a')}, xor(c, o))"
    return f"xor(list_reduce({octets}, lambda c, o: {step}, 4294967295::BIGINT), 4294967295)"
