"""Token counts: map-side two-tier lookup of pre-token lengths.

Tier one is a table of frequent pre-tokens and their token counts, at most
``table_size`` entries, broadcast to every executor.  Tier two is a bounded cache
in each Python worker; a miss is encoded there by the library's model.  Neither
tier changes a result: they only save work, so tier one may come from a bounded
sample of the documents.  No pre-token of the corpus is shuffled; the job is one
map over the documents.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import PreTokenizer, per_worker

LONGEST_CACHED = 64


class Lengths(dict):
    """Pre-token to token count; ``self[word]`` encodes and keeps what is missing."""

    def __init__(self, cutter: PreTokenizer, frequent: dict[str, int], cache_size: int):
        super().__init__(frequent)
        self.cutter, self.frequent, self.limit = cutter, frequent, cache_size + len(frequent)

    def __missing__(self, word: str) -> int:
        n = len(self.cutter.exact(word))
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n

    def count(self, text: str) -> int:
        return sum(1 if special else sum(map(self.__getitem__, words)) for special, words in self.cutter.parts(text))


def frequent_words(docs: DataFrame, spec: str, text_col: str, sample_docs: int, table_size: int) -> list[str]:
    """The ``table_size`` most frequent pre-tokens of about ``sample_docs`` sampled documents."""
    total = docs.count()
    if total == 0 or table_size == 0:
        return []
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    key = uuid.uuid4().hex

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = per_worker(key, lambda: PreTokenizer(shared.value))
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                for _, words in cutter.parts(text or ""):
                    seen.update(w for w in words if len(w) <= LONGEST_CACHED)
            yield pd.DataFrame({"word": list(seen), "n": list(seen.values())})

    sample = docs.select(F.col(text_col).alias("text")).sample(fraction=min(1.0, sample_docs / total), seed=42)
    top = (sample.mapInPandas(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "word").limit(table_size))
    return [r.word for r in top.collect()]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, sample_docs: int = 2000, table_size: int = 20_000,
                 cache_size: int = 300_000) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) per input row.

    ``tokenizer_path`` names a tokenizers JSON file, read on the driver; its text is
    broadcast (its size is fixed).  Counts equal the library's, special strings
    inside a text being special tokens as by its default.

    Edge cases: a null text is empty and has no tokens; repeated rows give
    repeated results; a null id stays null; an empty table gives no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    cutter = PreTokenizer(spec)
    table = {w: len(cutter.exact(w)) for w in frequent_words(docs, spec, text_col, sample_docs, table_size)}
    shared = docs.sparkSession.sparkContext.broadcast((spec, table))
    key = uuid.uuid4().hex

    def make() -> Lengths:
        text, frequent = shared.value
        return Lengths(PreTokenizer(text), frequent, cache_size)

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        lengths = per_worker(key, make)
        return pd.Series([lengths.count(t) if t else 0 for t in texts], dtype="int64")

    counted = docs.select(F.col(id_col).alias("id"),
                          F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                          n_tokens(F.col(text_col)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
