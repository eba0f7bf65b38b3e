"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item (a shorter item is one
window).  On both sides the k-grams of words are hashed and, in every run of
grams that a window holds, the minimum is kept; k = span/2, so a shared window
always shares a kept gram.  Kept grams of the documents first meet a bit table of
the benchmark's grams, whose size is fixed whatever the benchmark holds; the
survivors carry the words around them and are joined with the benchmark's grams.
Each distinct (gram, context) is extended to both sides once: a run of ``span``
equal words or more is a hit.  A gram with many surroundings in the benchmark (a
template's words) isn't extended against all of them: there the windows that
hold the gram are joined by their whole words.  Hits go back to the documents by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .pretokens import per_worker

# A-Z lower-cased; everything below 0x80 but digits and letters separates words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SLOTS = 1 << 24
MANY = 16            # surroundings of a benchmark gram beyond which its windows are joined by their words
HIT = "array<struct<size:int,gram:long,pos:int,lead:int,context:string>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(FOLD).split()


def gram_size(span: int) -> int:
    return (span + 1) // 2


def winnow(hashes: np.ndarray, doc_of: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the kept grams of all windows of ``span`` words inside one document."""
    k = gram_size(span)
    n, w = len(hashes), span - k + 1
    if n < span:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    gram = np.full(n - k + 1, span, dtype=np.uint64)
    for j in range(k):
        gram = (gram + hashes[j:n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        gram ^= gram >> np.uint64(29)
    low = gram[:n - span + 1].copy()
    for j in range(1, w):
        np.minimum(low, gram[j:j + len(low)], out=low)
    inside = doc_of[:n - span + 1] == doc_of[span - 1:]
    kept = np.zeros(len(gram), dtype=bool)
    for j in range(w):
        kept[j:j + len(low)] |= inside & (gram[j:j + len(low)] == low)
    at = np.flatnonzero(kept)
    return at, gram[at]


def find_grams(texts: list[str | None], spans: list[int], table: np.ndarray | None) -> tuple[list[int], list[list[tuple]]]:
    """Number of words and kept grams with their context per text; ``table`` filters the grams."""
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for s in split for w in s]
    hashes = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    doc_of, ends = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts)
    found: list[list[tuple]] = [[] for _ in texts]
    for span in spans:
        k = gram_size(span)
        at, gram = winnow(hashes, doc_of, span)
        if table is not None and len(gram):
            slot = (gram % np.uint64(SLOTS)).astype(np.int64)
            maybe = (table[slot >> 3] >> (slot & 7)) & 1 == 1
            at, gram = at[maybe], gram[maybe]
        for p, g in zip(at.tolist(), gram.astype(np.int64).tolist(), strict=True):
            d = int(doc_of[p])
            start = int(ends[d] - counts[d])
            lo, hi = max(start, p - (span - k)), min(int(ends[d]), p + span)
            found[d].append((span, g, p - start, p - lo, b" ".join(words[lo:hi]).decode("utf-8", "replace")))
    return counts.tolist(), found


def grams(texts: DataFrame, spans: list[int], slots: np.ndarray | None = None, group_bytes: int = 2 << 20) -> DataFrame:
    """``id``, ``n_words`` and ``hits`` (kept grams that pass the bit table) per row of (id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(slots)
    key = uuid.uuid4().hex

    @F.pandas_udf(f"n_words long, hits {HIT}")
    def scan(column: pd.Series) -> pd.DataFrame:
        table = per_worker(key, lambda: shared.value)
        counts, hits, group, size = [], [], [], 0
        for text in [*column, False]:
            if text is False or size >= group_bytes:
                n, h = find_grams(group, spans, table)
                counts += n
                hits += h
                group, size = [], 0
            if text is not False:
                group.append(text)
                size += len(text or "")
        return pd.DataFrame({"n_words": counts, "hits": hits})

    return texts.select("id", scan("text").alias("out")).select("id", "out.*")


def bit_table(bench: DataFrame) -> np.ndarray:
    """Bits of the benchmark's gram hashes: SLOTS / 8 bytes, gathered as at most SLOTS / 64 rows."""
    slot = F.expr(f"pmod(gram, {SLOTS}L)")
    rows = (bench.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).collect())
    table = np.zeros(SLOTS // 64, dtype="<i8")
    for word, bits in rows:
        table[word] = bits
    return table.view(np.uint8)


RUN = T.StructType([T.StructField("back", T.IntegerType()), T.StructField("ahead", T.IntegerType())])


@F.pandas_udf(RUN)
def extend(size: pd.Series, lead: pd.Series, context: pd.Series, item_lead: pd.Series, item: pd.Series) -> pd.DataFrame:
    """Equal words before the gram and from its start on; null where the run is shorter than the window."""
    out = []
    for n, p, text, q, other in zip(size, lead, context, item_lead, item, strict=True):
        a, b = text.split(" "), other.split(" ")
        back = 0
        while back < min(p, q) and a[p - back - 1] == b[q - back - 1]:
            back += 1
        ahead, room = 0, min(len(a) - p, len(b) - q)
        while ahead < room and a[p + ahead] == b[q + ahead]:
            ahead += 1
        out.append((back, ahead) if ahead >= gram_size(n) and back + ahead >= n else (None, None))
    return pd.DataFrame(out, columns=["back", "ahead"]).astype("Int32")


def windows_around(size: str, lead: str, context: str) -> Column:
    """The windows of ``size`` words that hold the gram at word ``lead`` of a context: their words, and how many
    of them come before the gram and from its start on (exploded as ``window``)."""
    words, n, at = F.split(F.col(context), " "), F.col(size), F.col(lead)
    first = F.greatest(at + F.floor((n + 1) / 2) - n, F.lit(0)).cast("int")   # the gram's words end inside the window
    last = F.least(at, F.size(words) - n).cast("int")
    starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.explode(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("words"),
                                                            (at - i).alias("back"), (n - at + i).cast("int").alias("ahead")))).alias("window")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", span: int = 10) -> DataFrame:
    """``id``, ``n_words``, ``n_hit``, ``items`` (sorted array of item ids as strings) and
    ``spans`` (word ranges, end exclusive, that may overlap) per input row.

    Edge cases: null texts and texts without words have no words and no hits; an
    item without words is never found; items with equal texts are all named; an item
    without id marks words and isn't named; repeated rows give repeated results;
    a very long text is scanned whole, with the texts of its group of 2 MB; extra columns of any name
    are ignored; with an empty benchmark every document is clean.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    sized = materialise(grams(items, []).select("n_words").distinct(), "item-sizes")
    lengths = [r.n_words for r in sized.where(F.col("n_words").between(1, span - 1)).collect()]
    spans = sorted({*lengths, span})
    own = F.when(F.col("n_words") < span, F.col("n_words")).otherwise(span)
    bench = materialise(grams(items, spans).select("id", own.alias("own"), F.explode("hits").alias("h")).where("h.size = own").select(
        F.col("id").alias("item"), "h.size", "h.gram", F.col("h.lead").alias("item_lead"), F.col("h.context").alias("item_context")), "item-grams")
    rows = materialise(grams(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), spans, bit_table(bench))
                       .withColumn("row", F.monotonically_increasing_id()), "document-grams")
    place = ["size", "gram", "lead", "context"]
    hits = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    around = bench.groupBy("size", "gram", "item_lead", "item_context").agg(F.collect_set("item").alias("items"))
    spread = around.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("contexts"))
    met = hits.select(*place).distinct().join(spread, ["size", "gram"])
    rare = met.where(F.col("contexts") <= MANY).join(around, ["size", "gram"]).withColumn(
        "run", extend("size", "lead", "context", "item_lead", "item_context")).where("run.ahead is not null")
    crowded = around.join(spread.where(F.col("contexts") > MANY), ["size", "gram"])
    held = (crowded.select("size", "gram", "items", windows_around("size", "item_lead", "item_context"))
            .groupBy("size", "gram", "window.words").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    equal = (met.where(F.col("contexts") > MANY).select(*place, windows_around("size", "lead", "context"))
             .select(*place, "window.words", F.struct("window.back", "window.ahead").alias("run")).join(held, ["size", "gram", "words"]))
    named = rare.select(*place, "run", "items").union(equal.select(*place, "run", "items")).groupBy(*place).agg(
        F.collect_set("run").alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    per_row = hits.join(named, place).groupBy("row").agg(
        F.flatten(F.collect_list(F.expr("transform(runs, r -> named_struct('start', pos - r.back, 'end', pos + r.ahead))"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.end - 1)))))")
    return rows.select("row", "id", "n_words").join(per_row, "row", "left").select(
        "id", "n_words", F.when(F.col("spans").isNull(), 0).otherwise(covered).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.array_sort(F.array_distinct("spans")), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
