"""Approximate nearest neighbours: a forest of random-projection trees.

The trees (random directions, split at medians) are fitted on a bounded sample;
every distinct vector is indexed by its leaf in each tree.  A query walks all trees
through one priority queue ordered by the smallest margin on the path and visits the
same number of leaves in that order; that number is calibrated: for a bounded
sample of queries the true neighbours are found by brute force over all vectors, and
the smallest number of visits that reaches the target recall is taken.

With more vectors than the sample can resolve the trees grow on: one direction per tree and
level, and one aggregate per level that gives the median of *all* vectors of every node.  These
medians stay a table.  The queue goes on level by level: a node's smallest margin never falls
below its parent's, so the first leaves of the queue descend from the first nodes of each level, and
each level keeps as many nodes per query as leaves are visited.  There the number of visits is
doubled until the trial queries reach the target.  So leaves have a constant size.

Leaf members
and visiting queries meet in a co-group, large leaves in several pieces; distances
there are exact, and only the best few of each piece travel on.

Equal vectors are one class that carries its few smallest ids, so a vector that a
third of the rows share is searched once.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .pretokens import per_worker


@dataclass
class Forest:
    """planes[t][l] has the directions of level l of tree t, cuts[t][l] their thresholds."""

    planes: list[list[np.ndarray]]
    cuts: list[list[np.ndarray]]

    @property
    def depth(self) -> int:
        return len(self.planes[0])

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        rng, planes, cuts = np.random.default_rng(seed), [], []
        for _ in range(trees if depth else 1):
            groups, own_planes, own_cuts = [np.arange(len(sample))], [], []
            for _ in range(depth):
                w = rng.standard_normal((len(groups), sample.shape[1]))
                w /= np.linalg.norm(w, axis=1, keepdims=True)
                p = [sample[g] @ x for g, x in zip(groups, w, strict=True)]
                cut = np.array([np.median(x) if len(x) else 0.0 for x in p])
                groups = [part for g, x, c in zip(groups, p, cut, strict=True) for part in (g[x < c], g[x >= c])]
                own_planes.append(w)
                own_cuts.append(cut)
            planes.append(own_planes)
            cuts.append(own_cuts)
        return cls(planes, cuts)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector (row) in every tree (column)."""
        out = np.zeros((len(vectors), len(self.planes)), dtype=np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            for w, c in zip(planes, cuts, strict=True):
                node = out[:, t]
                out[:, t] = node * 2 + (np.einsum("ij,ij->i", vectors, w[node]) >= c[node])
        return out

    def visits(self, query: np.ndarray, limit: int) -> list[tuple[int, int]]:
        """The first ``limit`` (tree, leaf) that the shared priority queue gives up."""
        return [at for at, _ in self.queue(query, limit)]

    def queue(self, query: np.ndarray, limit: int) -> list[tuple[tuple[int, int], float]]:
        """The same with the cost by which they came up."""
        margin = [[w @ query - c for w, c in zip(p, q, strict=True)] for p, q in zip(self.planes, self.cuts, strict=True)]
        queue = [(-np.inf, t, 0, 0) for t in range(len(self.planes))]
        out: list[tuple[tuple[int, int], float]] = []
        while queue and len(out) < limit:
            cost, t, level, node = heapq.heappop(queue)
            if level == self.depth:
                out.append(((t, node), float(cost)))
                continue
            m = float(margin[t][level][node])
            heapq.heappush(queue, (max(cost, m), t, level + 1, node * 2))
            heapq.heappush(queue, (max(cost, -m), t, level + 1, node * 2 + 1))
        return out


def usable(vector: Column) -> Column:
    """Neither null nor zero nor holding a null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def nearest(query: np.ndarray, members: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest Euclidean distances, ties to the smaller id."""
    diff = members - query
    score = np.sqrt((diff * diff).sum(axis=1))
    if len(score) > keep:
        near = np.flatnonzero(score <= np.partition(score, keep - 1)[keep - 1])
    else:
        near = np.arange(len(score))
    order = near[np.lexsort((ids[near], score[near]))][:keep]
    return ids[order], score[order]


def best(rows: DataFrame, group: str, keep: int, tie: str, name: str = "rank") -> DataFrame:
    order = Window.partitionBy(group).orderBy("score", tie)
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= keep)


def neighbours(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, trees: int = 4,
               leaf_rows: int = 256, sample_rows: int = 16_384, sample_bytes: int = 32 << 20, target: float = 0.97,
               calibration: int = 64, piece_rows: int = 4096, seed: int = 42) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score``: the ``k`` nearest found for every row of ``is_query``
    (a condition on ``id``) among all other ids, by exact Euclidean distance, ties to the smaller id.

    Edge cases: vectors that are null, zero or hold null or non-finite components, those
    whose length isn't the commonest, and rows without id take no part; repeated rows count
    once; equal vectors are at distance 0 of each other; with fewer than ``k`` other rows in the visited
    leaves all of them are returned; extra columns of any name are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    rows = materialise(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = common.n if common else 0
    rows = rows.where(F.size("v") == dim)
    first = Window.partitionBy("v").orderBy("id")
    members = (rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    classes = materialise(members.select(F.col("ids")[0].alias("class"), "v", "ids"), "classes")
    queries = materialise(rows.where(is_query), "queries")
    asked = queries.groupBy("v").agg(F.min("id").alias("q")).select("q", "v")

    total = classes.count()
    chosen = classes.orderBy(F.xxhash64("class"), "class").limit(max(1, min(sample_rows, sample_bytes // max(8, 8 * dim)))).select("v").collect()
    sample = np.array([r.v for r in chosen], dtype=np.float64).reshape(len(chosen), dim)
    wanted = int(np.log2(max(1, total / leaf_rows)))
    depth = max(0, min(wanted, int(np.log2(max(1, len(sample) / 8)))))
    forest = Forest.fit(sample, trees, depth, seed)
    if depth < wanted:
        found = deep_search(classes, asked, forest, wanted - depth, k, target, calibration, piece_rows, seed)
        return named_neighbours(found, classes, queries, asked, k)
    shared, key = spark.sparkContext.broadcast(forest), uuid.uuid4().hex

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = per_worker(key, lambda: shared.value)
        for batch in batches:
            if len(batch):
                leaf = f.leaves(matrix(batch["v"]))
                for t in range(leaf.shape[1]):
                    yield pd.DataFrame({"tree": t, "leaf": leaf[:, t], "class": batch["class"]})

    index = materialise(classes.select("class", "v").mapInPandas(place, "tree int, leaf long, class long"), "leaves")
    sizes = {(r.tree, r.leaf): r["count"] for r in index.groupBy("tree", "leaf").count().collect()}
    pieces = {at: -(-n // piece_rows) for at, n in sizes.items()}
    trial = asked.orderBy(F.xxhash64("q"), "q").limit(calibration).collect()
    visits = calibrated(classes, index, forest, trial, k, target)
    spread, spread_key = spark.sparkContext.broadcast((forest, pieces, visits)), uuid.uuid4().hex

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, cut, limit = per_worker(spread_key, lambda: spread.value)
        for batch in batches:
            for q, v in zip(batch["q"].tolist(), batch["v"], strict=True):
                at = [(t, n, p) for t, n in f.visits(np.asarray(v), limit) for p in range(cut.get((t, n), 0))]
                yield pd.DataFrame(at, columns=["tree", "leaf", "piece"]).assign(q=q, v=[v] * len(at))

    many = spark.sparkContext.broadcast(pieces)

    @F.pandas_udf("int")
    def piece(tree: pd.Series, leaf: pd.Series, spot: pd.Series) -> pd.Series:
        return pd.Series([s % many.value[t, n] for t, n, s in zip(tree.tolist(), leaf.tolist(), spot.tolist(), strict=True)], dtype="int32")

    cells = index.withColumn("piece", piece("tree", "leaf", F.expr("pmod(xxhash64(class), 1048576)"))).join(classes.select("class", "v"), "class")
    asking = asked.mapInPandas(walk, "tree int, leaf long, piece int, q long, v array<double>")

    return named_neighbours(searched(cells, asking, k), classes, queries, asked, k)


def searched(cells: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(q, class, score): the best few of every cell for the queries that visit it, by exact distance."""
    def search(inside: pd.DataFrame, searching: pd.DataFrame) -> pd.DataFrame:
        out, ids = [], inside["class"].to_numpy()
        if len(inside) and len(searching):
            data = matrix(inside["v"])
            for q, v in zip(searching["q"].tolist(), searching["v"], strict=True):
                found, score = nearest(np.asarray(v), data, ids, k + 1)
                out.append(pd.DataFrame({"q": q, "class": found, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "class": [], "score": []}).astype({"q": "int64", "class": "int64"})

    cell = ["tree", "leaf", "piece"]
    return cells.groupBy(*cell).cogroup(asking.groupBy(*cell)).applyInPandas(search, "q long, class long, score double")


def named_neighbours(found: DataFrame, classes: DataFrame, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The classes found for each distinct query vector, as ids for every query."""
    close = best(found.groupBy("q", "class").agg(F.min("score").alias("score")), "q", k + 1, "class")
    each = close.join(classes.select("class", "ids"), "class").select("q", "score", F.explode("ids").alias("id"))
    top = best(each, "q", k + 1, "id").select("q", "score", "id")
    named = queries.select(F.col("id").alias("query_id"), "v").join(asked, "v").select("query_id", "q")
    out = named.join(top, "q").where(F.col("id") != F.col("query_id"))
    return best(out, "query_id", k, "id").select("query_id", F.col("rank").cast("int"), "id", "score")


def deep_search(classes: DataFrame, asked: DataFrame, forest: Forest, levels: int, k: int, target: float,
                calibration: int, piece_rows: int, seed: int) -> DataFrame:
    """(q, class, score) found by trees that go ``levels`` below the sampled forest, split at medians of all vectors."""
    spark = classes.sparkSession
    dim = forest.planes[0][0].shape[1] if forest.depth else len(classes.first()["v"])
    below = np.random.default_rng((seed, 1)).standard_normal((len(forest.planes), levels, dim))
    shared, key = spark.sparkContext.broadcast((forest, below)), uuid.uuid4().hex

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, w = per_worker(key, lambda: shared.value)
        for batch in batches:
            if len(batch):
                v = matrix(batch["v"])
                leaf = f.leaves(v)
                for t in range(leaf.shape[1]):
                    yield pd.DataFrame({"tree": t, "leaf": leaf[:, t], "class": batch["class"], "p": list(v @ w[t].T)})

    node = ["tree", "leaf"]
    index, cuts = materialise(classes.select("class", "v").mapInPandas(place, "tree int, leaf long, class long, p array<double>"), "leaves"), []
    for level in range(levels):
        p = F.col("p")[level]
        cuts.append(materialise(index.groupBy(*node).agg(F.percentile_approx(p, 0.5, 1000).alias("cut")), "medians"))
        index = materialise(index.join(cuts[-1], node).select("tree", (F.col("leaf") * 2 + (p >= F.col("cut")).cast("long")).alias("leaf"), "class", "p"), "leaves")

    def visited(some: DataFrame, limit: int) -> DataFrame:
        """(q, tree, leaf): the first ``limit`` leaves of every query's queue."""
        def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f, w = per_worker(key, lambda: shared.value)
            for batch in batches:
                for q, v in zip(batch["q"].tolist(), batch["v"], strict=True):
                    first, v = f.queue(np.asarray(v), limit), np.asarray(v)
                    yield pd.DataFrame({"q": q, "tree": [t for (t, _), _ in first], "leaf": [n for (_, n), _ in first],
                                        "cost": [c for _, c in first], "p": [w[t] @ v for (t, _), _ in first]})

        walk = some.select("q", "v").mapInPandas(begin, "q long, tree int, leaf long, cost double, p array<double>")
        order = Window.partitionBy("q").orderBy("cost", "tree", "leaf")     # twice ``limit`` rows
        for level, cut in enumerate(cuts):
            margin = F.col("p")[level] - F.col("cut")
            sides = F.array(F.struct((F.col("leaf") * 2).alias("leaf"), F.greatest("cost", margin).alias("cost")),
                            F.struct((F.col("leaf") * 2 + 1).alias("leaf"), F.greatest("cost", -margin).alias("cost")))
            walk = (walk.join(cut, node).select("q", "tree", "p", F.inline(sides)).withColumn("k", F.row_number().over(order))
                    .where(F.col("k") <= limit).drop("k"))
        return walk.select("q", "tree", "leaf")

    trial = materialise(asked.orderBy(F.xxhash64("q"), "q").limit(calibration), "trial")
    true = materialise(true_neighbours(classes, trial.collect(), k).join(index.select("tree", "leaf", "class"), "class"), "trial-neighbours")
    wanted, limit = true.select("q", "class").distinct().count(), 8
    while wanted and true.join(visited(trial, limit), ["q", *node]).select("q", "class").distinct().count() < target * wanted:
        limit *= 2
    sizes = materialise(index.groupBy(*node).agg(F.ceil(F.count(F.lit(1)) / piece_rows).cast("int").alias("pieces")), "leaf-sizes")
    cells = index.select("tree", "leaf", "class").join(sizes, node).select(
        *node, F.expr("cast(pmod(xxhash64(class), pieces) as int)").alias("piece"), "class").join(classes.select("class", "v"), "class")
    asking = visited(asked, limit).join(sizes, node).select("q", *node, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).join(asked, "q")
    return searched(cells, asking, k)


def true_neighbours(classes: DataFrame, queries: list, k: int) -> DataFrame:
    """(q, class) of the nearest classes of a bounded list of queries (q, v), by brute force over all of them."""
    shared = classes.sparkSession.sparkContext.broadcast([(r.q, np.array(r.v)) for r in queries])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                data, ids = matrix(batch["v"]), batch["class"].to_numpy()
                for q, v in shared.value:
                    near, score = nearest(v, data, ids, k + 1)
                    yield pd.DataFrame({"q": q, "class": near, "score": score})

    return best(classes.select("class", "v").mapInPandas(scan, "q long, class long, score double"), "q", k + 1, "class").select("q", "class")


def calibrated(classes: DataFrame, index: DataFrame, forest: Forest, queries: list, k: int, target: float) -> int:
    """The smallest number of leaf visits that finds ``target`` of the true neighbours of the trial queries."""
    everything = len(forest.planes) << forest.depth
    if not queries or everything == 1:
        return everything
    leaves = true_neighbours(classes, queries, k).join(index, "class").select("q", "class", "tree", "leaf").collect()
    turn = {r.q: {at: i + 1 for i, at in enumerate(forest.visits(np.array(r.v), everything))} for r in queries}
    needed: dict[tuple[int, int], int] = {}
    for r in leaves:
        at = turn[r.q][r.tree, r.leaf]
        needed[r.q, r["class"]] = min(at, needed.get((r.q, r["class"]), at))
    order = sorted(needed.values())
    return order[min(len(order) - 1, int(np.ceil(target * len(order))) - 1)]
