"""Connected components of a distributed edge table (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root): root is the smallest node id reachable.  ``edges`` holds (a, b) longs.

    Each round links the larger neighbours of every node to its smallest
    neighbour (large star), then the smaller ones (small star).  Minima are
    combined map-side and joined back, so a node with many neighbours is never
    gathered in one task; the edge table is written to the shared folder every
    round and stays there.  The number of rounds is logarithmic; ``max_rounds`` is
    a guard that raises instead of returning an unfinished result.
    """
    current = materialise(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _fingerprint(current)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = current.union(current.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        current = materialise(lowest.select("a", F.col("low").alias("b")).union(small).distinct(), "edges")
        before, mark = mark, _fingerprint(current)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
    return row[0], row[1]
