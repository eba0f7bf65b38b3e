"""SMOTE oversampling with a nearest-neighbour forest.

kNN plan: exact search does not prune in 40 columns, so neighbours come from a
forest of projection trees with exact re-ranking inside the leaves.

1. Minority rows collapse to *distinct* vectors with a multiplicity, so a vector
   repeated by a third of the rows is one row here.
2. A bounded sample gives the principal axes and, per tree, median split points
   along random directions weighted to those axes, as deep as it can resolve.
3. Every vector goes to one node per tree.  Nodes that hold more than a leaf are split
   further at medians of *all* their vectors: one aggregate per level gives the size and the
   median of every open node of every tree, and its vectors move to the two halves.  So a leaf has the
   same size however many vectors there are and however badly the sample fits them.
4. Each leaf is one small group: all distances by a matrix product, the best k
   re-ranked on exact differences.  A node that no direction splits is cut into pieces.
5. The lists of a vector's leaves are merged to its k nearest.

Work per vector is (trees x leaf size) distances and one pass per level.

Synthetic rows: n_new = floor(ratio·n_majority) − n_minority; minority rows
take ⌊n_new / n_min⌋ copies, one more for the first n_new mod n_min rows in
seeded hash order; each copy picks one of its k neighbours and
λ ~ U[0, 1) from a seeded hash and becomes x + λ·(x_nn − x).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEED, SMOTE_K
from ..session import cut_lineage
from .ordered import running_sums
from .sampling import hash_bucket, seeded_hash

TREES = 12
LEAF_ROWS = 200
SAMPLE_ROWS = 20_000
SAMPLE_PER_LEAF = 8
MAX_LEVELS = 48        # below the sampled ones; a median halves, so a node ends sooner unless its vectors coincide


class InfeasibleRatio(ValueError):
    """The asked ratio is not above the current one: nothing to oversample."""


def plant_forest(sample: np.ndarray, n_rows: int, trees: int, leaf_rows: int, seed: int) -> dict:
    """Directions and median split points of every tree's top levels, from a bounded sample; principal axes."""
    rng = np.random.default_rng(seed)
    centred = sample - sample.mean(axis=0)
    _, spread, axes = np.linalg.svd(centred, full_matrices=False)
    wanted = max(0, math.ceil(math.log2(max(1.0, n_rows / leaf_rows))))
    depth = min(wanted, max(0, int(math.log2(max(1, len(sample) / SAMPLE_PER_LEAF)))))
    forest = []
    for _ in range(trees if wanted else 1):
        directions = (rng.standard_normal((depth, len(spread))) * spread) @ axes
        groups, cuts = [np.arange(len(sample))], []
        for level in range(depth):
            projected = [sample[g] @ directions[level] for g in groups]
            cut = np.array([np.median(p) if len(p) else 0.0 for p in projected])
            groups = [part for g, p, c in zip(groups, projected, cut) for part in (g[p < c], g[p >= c])]
            cuts.append(cut)
        forest.append((directions, cuts))
    return {"forest": forest, "spread": spread, "axes": axes}


def leaves(x: np.ndarray, model: dict) -> np.ndarray:
    """Node of every row in every tree after the sampled levels: a one and a bit per level."""
    out = np.ones((len(x), len(model["forest"])), dtype=np.int64)
    for t, (directions, cuts) in enumerate(model["forest"]):
        for direction, cut in zip(directions, cuts):
            out[:, t] = out[:, t] * 2 + (x @ direction >= cut[out[:, t] - len(cut)])
    return out


def grown(placed: DataFrame, model: dict, leaf_rows: int, seed: int) -> DataFrame:
    """(x, m, vid, tree, leaf, piece): nodes of ``placed`` split at their own medians until they are leaves."""
    spread, axes = model["spread"], model["axes"]
    least = 1e-3 * (spread.max() or 1.0)  # so that a direction also sees what the sample didn't
    done = []
    for level in range(MAX_LEVELS):
        rng = np.random.default_rng((seed, level))
        directions = (rng.standard_normal((len(model["forest"]), len(spread))) * spread) @ axes
        directions += least * rng.standard_normal(directions.shape)

        def project(batches: Iterator[pd.DataFrame], directions=directions) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield batch.assign(p=(np.stack(batch["x"].to_numpy()) * directions[batch["tree"].to_numpy()]).sum(axis=1))

        sizes = cut_lineage(placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")))
        done.append(placed.join(sizes.where(F.col("n") <= leaf_rows).drop("n"), ["tree", "leaf"]).withColumn("piece", F.lit(0)))
        large = sizes.where(F.col("n") > leaf_rows)
        if not large.limit(1).count():
            break
        if level == MAX_LEVELS - 1:  # as good as equal vectors
            done.append(placed.join(large, ["tree", "leaf"]).withColumn(
                "piece", F.pmod(F.xxhash64("vid"), F.ceil(F.col("n") / leaf_rows)).cast("int")).drop("n"))
            break
        projected = cut_lineage(placed.join(large.drop("n"), ["tree", "leaf"]).select("x", "m", "vid", "tree", "leaf").mapInPandas(
            project, "x array<double>, m long, vid long, tree int, leaf long, p double"))
        cuts = projected.groupBy("tree", "leaf").agg(F.percentile_approx("p", 0.5, 1000).alias("cut"))
        placed = cut_lineage(projected.join(cuts, ["tree", "leaf"]).select(
            "x", "m", "vid", "tree", (F.col("leaf") * 2 + (F.col("p") > F.col("cut")).cast("long")).alias("leaf")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def nearest_in_leaf(x: np.ndarray, k: int, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(neighbour positions, exact squared distances), k per row, the row itself excluded."""
    square, take = (x * x).sum(axis=1), min(k, len(x) - 1)
    near, dist = np.empty((len(x), take), dtype=np.int64), np.empty((len(x), take))
    for lo in range(0, len(x), chunk):
        part = x[lo:lo + chunk]
        d = square[lo:lo + chunk, None] + square[None, :] - 2 * part @ x.T
        d[np.arange(len(part)), np.arange(lo, lo + len(part))] = np.inf
        more = min(take + 4, len(x) - 1)  # a margin for the product's rounding
        found = np.argpartition(d, more - 1, axis=1)[:, :more] if more else np.zeros((len(part), 0), dtype=np.int64)
        exact = ((part[:, None, :] - x[found]) ** 2).sum(axis=2)
        order = np.lexsort((found, exact), axis=1)[:, :take]
        near[lo:lo + chunk] = np.take_along_axis(found, order, axis=1)
        dist[lo:lo + chunk] = np.take_along_axis(exact, order, axis=1)
    return near, dist


def knn_lists(minority: DataFrame, k: int = SMOTE_K, seed: int = SEED, trees: int = TREES,
              leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(x, nn) per distinct minority vector: ``nn`` holds its k nearest copies
    (Euclidean) found by the forest, self-copies first when the vector repeats."""
    spark = minority.sparkSession
    distinct = cut_lineage(minority.select(vector_to_array("features").alias("x")).groupBy("x")
                           .agg(F.count(F.lit(1)).alias("m")).withColumn("vid", F.monotonically_increasing_id()))
    sample = np.array([r["x"] for r in distinct.orderBy(F.xxhash64("x"), "vid").limit(SAMPLE_ROWS).select("x").collect()])
    n = distinct.count()
    if n == 0:
        return distinct.select("x", F.array().cast("array<array<double>>").alias("nn"))
    planted = plant_forest(sample, n, trees, leaf_rows, seed)
    model = spark.sparkContext.broadcast(planted)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = leaves(np.stack(batch["x"].to_numpy()), model.value)
                for t in range(at.shape[1]):
                    yield batch.assign(tree=t, leaf=at[:, t])

    def rank(group: pd.DataFrame) -> pd.DataFrame:
        x, ids, copies = np.stack(group["x"].to_numpy()), group["vid"].to_numpy(), group["m"].to_numpy()
        near, dist = nearest_in_leaf(x, k)
        flat = near.ravel()
        return pd.DataFrame({"vid": np.repeat(ids, near.shape[1]), "d": dist.ravel(), "other": ids[flat], "m": copies[flat]})

    placed = cut_lineage(distinct.mapInPandas(place, "x array<double>, m long, vid long, tree int, leaf long"))
    pairs = grown(placed, planted, leaf_rows, seed).groupBy("tree", "leaf", "piece").applyInPandas(rank, "vid long, d double, other long, m long")
    best = nearest_vectors(pairs, distinct, k)
    own = F.array_repeat(F.col("x"), F.least(F.col("m") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform(F.coalesce("best", F.array().cast(best.schema["best"].dataType)),
                                   lambda s: F.array_repeat(s["y"], F.least(s["m"], F.lit(k)).cast("int"))))
    return cut_lineage(distinct.join(best, "vid", "left").select("x", F.slice(F.concat(own, others), 1, k).alias("nn")))


def nearest_vectors(pairs: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(vid, best): the ``k`` nearest of (vid, d, other, m) as structs with the vector ``y`` of each.  Pairs are told
    apart and ranked by number; only those that stay, k of up to trees x k, get their vectors."""
    ranked = pairs.groupBy("vid").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "other", "m"))), 1, k).alias("best"))
    kept = ranked.select("vid", F.posexplode("best").alias("at", "b")).select("vid", "at", "b.other", "b.m")
    return (kept.join(vectors.select(F.col("vid").alias("other"), F.col("x").alias("y")), "other")
            .groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("at", "m", "y"))).alias("best")))


def class_sizes(df: DataFrame, label: str = "label") -> tuple[int, int]:
    """(minority rows, majority rows): labels 1 and 0."""
    counts = {int(r[label]): int(r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.get(1, 0), counts.get(0, 0)


def smote(df: DataFrame, ratio: float, k: int = SMOTE_K, seed: int = SEED,
          label: str = "label", key: str = "ID", lists: DataFrame | None = None) -> DataFrame:
    """Original rows plus synthetic minority rows (label 1), ``synthetic`` flag.

    ``lists`` are the neighbours of the minority rows if they are known already.
    Raises InfeasibleRatio when ``ratio`` is not above the current one.
    """
    n_min, n_maj = class_sizes(df, label)
    n_new = int(ratio * n_maj) - n_min
    if n_new <= 0 or n_min == 0:
        raise InfeasibleRatio(f"SMOTE ratio {ratio} is not above the current minority ratio "
                              f"{n_min / max(n_maj, 1):.4f}: nothing to oversample")
    minority = df.filter(F.col(label) == 1)
    lists = knn_lists(minority, k, seed) if lists is None else lists
    new = synthetic_rows(minority, n_min, n_new, lists, seed, key).select(
        F.lit(None).cast(df.schema[key].dataType).alias(key), "features", F.lit(1).cast(df.schema[label].dataType).alias(label),
        F.lit(True).alias("synthetic"))
    return df.withColumn("synthetic", F.lit(False)).select(key, "features", label, "synthetic").unionByName(new)


def synthetic_rows(minority: DataFrame, n_min: int, n_new: int, lists: DataFrame, seed: int = SEED, key: str = "ID") -> DataFrame:
    """(key of the origin, features, number): ``n_new`` new rows numbered from 1.  Fewer rows are the
    same rows up to a smaller number, so one table serves every ratio."""
    h = minority.withColumn("_h", seeded_hash(key, seed)).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(h, [("_h", True), (key, True)], ["_one"], bucket=hash_bucket(h))
    per, extra = divmod(n_new, n_min)
    copies = F.lit(per) + F.when(F.col("cum__one") <= extra, 1).otherwise(0)
    rows = (ranked.withColumn("x", vector_to_array("features"))
            .filter(copies > 0)
            .withColumn("c", F.explode(F.sequence(F.lit(1), copies))))
    rows = rows.join(lists.select("x", "nn"), "x")
    pick = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("c")), F.size("nn")) + 1
    lam = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col("c")), F.lit(1 << 30)) / float(1 << 30)
    nn = F.element_at("nn", pick.cast("int"))
    return rows.select(key, array_to_vector(F.zip_with("x", nn, lambda a, b: a + lam * (b - a))).alias("features"),
                       ((F.col("c") - 1) * n_min + F.col("cum__one")).cast("long").alias("number"))
