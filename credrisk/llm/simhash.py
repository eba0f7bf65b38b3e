"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by pigeonring filtering.

The fingerprint is computed per text in Python workers.  Everything after it
works on distinct fingerprints, so a group of exact copies is one row.

Pigeonring: cut the 64 bits into a ring of m segments.  If two fingerprints
differ in at most t bits, some segment starts a chain whose first l segments
differ in at most l*t/m bits for every l.  With m = 8 and t = 2 that means three
equal segments, at most one differing bit in the first seven, and two in all.  The
chain's beginning becomes equality keys: its equal segments and all but one of the next
two, of which one at most may differ (16 keys of 32 bits).  Fingerprints that share a
key are candidates; those whose cumulative differences leave the budget of any
proper beginning of that chain are pruned, and only the rest meet the Hamming check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash64(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint; bit 1 where over half the shingle hashes have it."""
    tokens = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) < words:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1)
        starts = [0, *ends[:-1].tolist()]
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[words - 1:] - 1).tolist())]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = [np.bincount(octets[:, 7 - k], minlength=256) @ BITS for k in range(8)]
    on = np.concatenate(ones) * 2 > len(hashes)
    return int.from_bytes(np.packbits(on).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) per input row."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t, words) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def chain_keys(max_bits: int, segments: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For every start of a chain: bit mask of an equality key, and the chain's proper beginnings as (bit mask, budget).

    Of the beginnings with one budget the longest holds the others.
    """
    if max_bits == 0:
        return [(2**64 - 1, [])]
    width = 64 // segments
    longest = {b: max(l for l in range(1, segments + 1) if l * max_bits // segments <= b) for b in range(max_bits)}
    equal = longest[0]
    if equal < 1 or 64 % segments:
        raise ValueError("the number of segments must divide 64 and exceed the number of bits")
    loose = min(2, longest.get(1, equal) - equal)   # segments behind the equal ones, of which one may differ

    def mask(start: int, places) -> int:
        return sum(((1 << width) - 1) << (width * ((start + k) % segments)) for k in places)

    return [(mask(start, [k for k in range(equal + loose) if k != left_out]), [(mask(start, range(l)), b) for b, l in longest.items()])
            for start in range(segments) for left_out in (range(equal, equal + loose) if loose else [-1])]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def candidates(prints: DataFrame, max_bits: int = 2, segments: int = 8) -> DataFrame:
    """(key, a, b, diff): distinct fingerprints ``fp`` that share a chain's key, a < b."""
    masks = [F.col("fp").bitwiseAND(F.lit(signed(m))) for m, _ in chain_keys(max_bits, segments)]
    keyed = prints.select("fp", F.posexplode(F.array(*masks)).alias("key", "part"))
    pairs = keyed.alias("x").join(keyed.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part"))
                                  & (F.col("x.fp") < F.col("y.fp")))
    return pairs.select("x.key", F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.fp").bitwiseXOR(F.col("y.fp")).alias("diff"))


def within_chain(max_bits: int, segments: int) -> Column:
    """Whether ``diff`` keeps every proper beginning of the chain of ``key`` within its cumulative budget."""
    keys = chain_keys(max_bits, segments)
    fits = F.lit(True)
    for level, (_, budget) in enumerate(keys[0][1]):
        masks = F.array(*[F.lit(signed(begins[level][0])) for _, begins in keys])
        fits = fits & (F.bit_count(F.col("diff").bitwiseAND(F.get(masks, F.col("key")))) <= budget)
    return fits


def links(prints: DataFrame, max_bits: int = 2, segments: int = 8) -> DataFrame:
    """(a, b): distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    kept = candidates(prints, max_bits, segments).where(within_chain(max_bits, segments))
    return kept.where(F.bit_count("diff") <= max_bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    max_bits: int = 2, segments: int = 8) -> DataFrame:
    """One row per input row: ``id``, ``fp`` (signed 64 bits) and ``component``, the smallest
    id reachable over links of at most ``max_bits`` differing bits.

    Edge cases: null, empty and blank texts have fingerprint zero and link like
    any other; repeated rows share their fingerprint; a row without id gets the
    smallest id of its component and never names one; a very long text is read whole;
    extra columns of any name are ignored; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    stars = connected_components(links(distinct.select("fp"), max_bits, segments))
    rooted = distinct.join(stars, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component"))
    component = rooted.select("fp", "root").join(smallest, "root").select("fp", "component")
    return prints.join(component, "fp").select("id", "fp", "component")
