"""Random forest whose trees never pass through the driver.

MLlib keeps every open and finished node of a forest in the driver, which some ten thousand
nodes in each of 200 deep trees outgrow.  Here the matrix is binned once, a task takes its rows and
grows some of the trees to their end, and the trees stay a table of the shared folder, from which
the model scores: rows in blocks meet groups of trees, their sums are added up per block.

The binned rows of a task lie in a temporary file that is mapped, not in its memory (as do the trees of
a scoring task); beside it stay, by estimate, some 40 bytes a row drawn for the tree in work.

The settings are MLlib's: 32 quantile bins, rows drawn Poisson(1) times per tree, the square root of the
features tried per node, Gini impurity, leaves of one row, class shares averaged over trees.
"""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEED
from ..session import cut_lineage, workers_find_package
from .boosting import binned, cut_points, in_order, uniform

MAX_BINS = 32
NODES_AT_ONCE = 4096       # nodes of a level whose sums are held together
ROWS_AT_ONCE = 1 << 17     # rows that are added to them together
BLOCK_ROWS = 1 << 20       # rows that one scoring task takes
GROUP_BYTES = 1 << 27      # trees that one scoring task takes, one after another
TASKS_PER_CORE = 6         # tasks that share out the trees, so that all cores end at about the same time
LEAST_GAIN = 1e-12
TREES = "tree int, nodes binary, importances array<double>"
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


class Spool:
    """Byte strings in a temporary file, so that what a task is sent need not stay in its memory."""

    def __init__(self) -> None:
        self.file, self.places = tempfile.TemporaryFile(), []

    def add(self, key: tuple, content: bytes) -> None:
        self.places.append((key, self.file.tell(), len(content)))
        self.file.write(content)

    def __iter__(self) -> Iterator[tuple[tuple, bytes]]:
        """In the order of the keys."""
        for key, begins, size in sorted(self.places):
            self.file.seek(begins)
            yield key, self.file.read(size)


def mapped(shape: tuple, dtype: type) -> np.ndarray:
    """An array in a temporary file."""
    return np.asarray(np.memmap(tempfile.TemporaryFile(), dtype=dtype, mode="w+", shape=shape)) if math.prod(shape) else np.empty(shape, dtype=dtype)


def drawn_times(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample holds each row."""
    times = np.empty(len(ids), dtype=np.int8)
    for lo in range(0, len(ids), ROWS_AT_ONCE):
        part = slice(lo, lo + ROWS_AT_ONCE)
        times[part] = np.searchsorted(POISSON, uniform(ids[part], seed * 1_000_003 + tree), side="right")
    return times


def parts_of(begins: np.ndarray, lo: int, hi: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of the nodes from ``lo`` to ``hi``, some at a time, with the node of each, counted from ``lo``."""
    for a in range(begins[lo], begins[hi], ROWS_AT_ONCE):
        b = min(a + ROWS_AT_ONCE, begins[hi])
        first, last = np.searchsorted(begins, (a, b - 1), side="right") - 1
        counts = np.minimum(begins[first + 1:last + 2], b) - np.maximum(begins[first:last + 1], a)
        yield slice(a, b), np.repeat(np.arange(first - lo, last + 1 - lo), counts)


def best_cuts(sums: np.ndarray, tried: np.ndarray) -> tuple:
    """Gain, feature and last bin on the left of every node's best split from sums of both classes
    (tries, nodes, 2, bins); ``tried`` has the features of every node.  For two classes the Gini gain is
    twice what squares of class 1 over rows gain; a side without rows adds nothing."""
    n = len(tried)
    gain, feature, last = np.full(n, -np.inf), np.zeros(n, dtype=np.int16), np.zeros(n, dtype=np.uint8)
    for j in range(tried.shape[1]):
        left = sums[j].cumsum(axis=2)
        ones, rows = left[:, 1], left[:, 0]
        rows += ones
        ones_right, rows_right = ones[:, -1:] - ones, rows[:, -1:] - rows
        whole = ones[:, -1] ** 2 / np.maximum(rows[:, -1], 1e-9)
        found = ones * ones
        found /= np.maximum(rows, 1e-9, out=rows)
        ones_right *= ones_right
        ones_right /= np.maximum(rows_right, 1e-9, out=rows_right)
        found += ones_right
        at = found[:, :-1].argmax(axis=1)
        found = 2 * (found[np.arange(n), at] - whole)
        better = found > gain
        gain[better], feature[better], last[better] = found[better], tried[better, j], at[better]
    return gain, feature, last


def grow_tree(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, n_bins: int, max_depth: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """A tree on the rows of ``bins`` (features, rows) with a weight, level by level: split feature (-1 in a leaf), last bin
    on the left, left child, share of class 1, gain.  A level's rows lie in the order of its nodes."""
    n_features = len(bins)
    flat = np.ascontiguousarray(bins.T).reshape(-1)   # a row's bins lie together; no copy where they do already
    size = max(1, math.ceil(math.sqrt(n_features)))
    at, done, levels = np.flatnonzero(weight).astype(np.int32), 0, []
    begins = np.array([0, len(at)])
    for depth in range(max_depth + 1):
        nodes, ends = len(begins) - 1, depth == max_depth or n_bins <= 1
        level = {"feature": np.full(nodes, -1, dtype=np.int16), "bin": np.zeros(nodes, dtype=np.uint8), "child": np.zeros(nodes, dtype=np.int32),
                 "share": np.zeros(nodes), "gain": np.zeros(nodes)}
        levels.append(level)
        done += nodes
        right = np.empty(len(at), dtype=bool)
        for lo in range(0, nodes, NODES_AT_ONCE):
            hi = min(nodes, lo + NODES_AT_ONCE)
            tried = rng.random((hi - lo, n_features)).argsort(axis=1)[:, :1 if ends else size]
            sums, by_try = np.zeros((tried.shape[1], (hi - lo) * 2 * n_bins)), np.ascontiguousarray(tried.T)
            for part, node in parts_of(begins, lo, hi):
                rows = at[part]
                base, w = rows.astype(np.int64) * n_features, weight.take(rows)
                first = int(node[0]) * 2 * n_bins
                cell = (node * 2 + label.take(rows)) * n_bins - first
                for j, column in enumerate(by_try):
                    found = np.bincount(cell + flat.take(base + column.take(node)), weights=w)
                    sums[j, first:first + len(found)] += found
            sums = sums.reshape(len(sums), hi - lo, 2, n_bins)
            classes = sums[0].sum(axis=2)
            total = classes.sum(axis=1)
            level["share"][lo:hi] = classes[:, 1] / np.maximum(total, 1e-300)
            if ends:
                continue
            gain, feature, last = best_cuts(sums, tried)
            split = gain > LEAST_GAIN * np.maximum(total, 1)
            level["feature"][lo:hi][split], level["bin"][lo:hi][split], level["gain"][lo:hi][split] = feature[split], last[split], gain[split]
            for part, node in parts_of(begins, lo, hi):
                right[part] = flat.take(at[part].astype(np.int64) * n_features + feature.take(node)) > last.take(node)
        split = level["feature"] >= 0
        if not split.any():
            break
        level["child"][split] = done + 2 * (np.cumsum(split[split]) - 1)
        at, begins = halved(at, begins, split, right)
    return {k: np.concatenate([lv[k] for lv in levels]) for k in levels[0]}


def halved(at: np.ndarray, begins: np.ndarray, split: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the nodes that split, each node's to the left before those to the right, otherwise in their order; the children's begins."""
    rows = np.diff(begins)
    if not split.all():
        still = np.repeat(split, rows)
        at, right, rows = at[still], right[still], rows[split]
    parents = np.concatenate([[0], np.cumsum(rows)])
    passed = np.concatenate([[0], np.cumsum(right, dtype=np.int32)]).astype(np.int32)   # rows to the right before each row
    to_right = np.diff(passed[parents])
    out = np.empty_like(at)
    own = np.repeat((parents[:-1] - passed[parents[:-1]]).astype(np.int32), rows)   # rows to the left before each node
    shift = np.repeat((parents[1:] - to_right).astype(np.int32), rows)
    place = np.arange(len(at), dtype=np.int32) - passed[:-1]    # rows to the left before each row
    place += np.repeat((parents[:-1]).astype(np.int32), rows) - own
    turned = passed[:-1] - np.repeat(passed[parents[:-1]], rows) + shift
    out[np.where(right, turned, place)] = at
    children = np.empty(2 * len(rows) + 1, dtype=np.int64)
    children[0::2], children[1::2] = parents, parents[1:] - to_right
    return out, children


def tree_shares(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """Share of class 1 in the leaf that each row reaches."""
    node, rows = np.zeros(bins.shape[1], dtype=np.int32), np.arange(bins.shape[1])
    while len(rows):
        here = node[rows]
        feature = tree["feature"][here]
        inner = feature >= 0
        rows, here, feature = rows[inner], here[inner], feature[inner]
        node[rows] = tree["child"][here] + (bins[feature, rows] > tree["bin"][here])
    return tree["share"][node]


def fit_forest(rows: DataFrame, trees: int, max_depth: int, seed: int = SEED) -> ForestModel:
    """Forest on rows (id, x, label, weights with one entry)."""
    spark = rows.sparkSession
    workers_find_package(spark)
    cuts = cut_points(rows, MAX_BINS)
    n_bins, n_features = max(1, *map(len, cuts)) + 1, len(cuts)

    hands = min(trees, TASKS_PER_CORE * max(1, spark.sparkContext.defaultParallelism))

    def by_hand(chunk: tuple) -> Iterator[tuple[int, tuple]]:
        ids, bins, label, weights = chunk
        piece = ids, np.ascontiguousarray(bins.T), label.astype(np.int8), weights[0]
        return ((h, piece) for h in range(hands))

    def grow(items: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
        found: defaultdict[int, Spool] = defaultdict(Spool)
        for h, (order, chunk) in items:
            found[h].add((order, len(pickle.loads(chunk)[0])), chunk)
        for h, spool in found.items():
            n, done = sum(key[1] for key, _, _ in spool.places), 0
            ids, bins, label, weight = mapped((n,), np.uint64), mapped((n, n_features), np.uint8), mapped((n,), np.int8), mapped((n,), np.float32)
            for (_, m), chunk in spool:
                for whole, a in zip((ids, bins, label, weight), pickle.loads(chunk), strict=True):
                    whole[done:done + m] = a
                done += m
            spool.file.close()
            for t in range(h, trees, hands):
                tree = grow_tree(bins.T, label, drawn_times(ids, t, seed) * weight.astype(np.float64), n_bins, max_depth, np.random.default_rng((seed, t)))
                gains = np.bincount(np.maximum(tree["feature"], 0), weights=tree.pop("gain"), minlength=n_features)
                yield t, bytearray(pickle.dumps(tree, protocol=5)), (gains / (gains.sum() or 1.0)).tolist()

    grown = binned(rows, cuts, by_hand).partitionBy(hands, lambda h: h).mapPartitions(grow)
    table = cut_lineage(spark.createDataFrame(grown, TREES))
    total = np.sum([r[0] for r in table.select("importances").collect()], axis=0)   # one short list per tree
    model = ForestModel()._set(cuts=[[float(c) for c in cs] for cs in cuts], importances=(total / (total.sum() or 1.0)).tolist())
    model.table = table
    return model


class ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:  # noqa: N802 - the name that MLlib's writers use
        super().saveImpl(path)
        self.instance.table.write.parquet(f"{path}/trees")


class ForestReader(DefaultParamsReader):
    def load(self, path: str) -> ForestModel:
        model = super().load(path)
        model.table = self.sparkSession.read.schema(TREES).parquet(f"{path}/trees")
        return model


class ForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Cut points and importances; the trees are ``table``.  Adds ``probability`` (a vector of both classes)."""

    cuts = Param(Params._dummy(), "cuts", "upper bounds of the bins of every feature", TypeConverters.toList)
    importances = Param(Params._dummy(), "importances", "shares of the impurity decrease", TypeConverters.toListFloat)
    table: DataFrame

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader(cls)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that MLlib's models use
        return DenseVector(self.getOrDefault(self.importances))

    def _transform(self, df: DataFrame) -> DataFrame:
        spark, uid = df.sparkSession, f"u_{uuid.uuid4().hex}"
        workers_find_package(spark)
        kept = cut_lineage(df.withColumn(uid, F.monotonically_increasing_id()))
        bounds, n = [np.array(c) for c in self.getOrDefault(self.cuts)], kept.count()
        trees, size = self.table.agg(F.count(F.lit(1)), F.sum(F.length("nodes"))).first()
        blocks = max(1, -(-n // BLOCK_ROWS))
        groups = min(trees, max(-(-size // GROUP_BYTES), -(-3 * spark.sparkContext.defaultParallelism // blocks)))

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part = TaskContext.get().partitionId()
            for i, batch in enumerate(b for b in batches if len(b)):
                x = np.stack(batch["x"].to_numpy())
                bins = np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(bounds)]).astype(np.uint8)
                yield pd.DataFrame({"block": [(part + i) % blocks], "at": [(part << 32) + i], "chunk": [pickle.dumps((batch[uid].to_numpy(), bins), protocol=5)]})

        chunks = kept.select(uid, vector_to_array("features").alias("x")).mapInPandas(place, "block long, at long, chunk binary")
        dealt = chunks.rdd.flatMap(lambda r: [(r[0] * groups + g, (0, r[1], bytes(r[2]))) for g in range(groups)])
        dealt = dealt.union(self.table.select("tree", "nodes").rdd.flatMap(
            lambda r: [(b * groups + r[0] % groups, (1, r[0], bytes(r[1]))) for b in range(blocks)]))

        def score(items: Iterator[tuple]) -> Iterator[tuple]:
            """(block, (ids, sums over this group's trees)); the ids, whose order is the same in all groups, from one group."""
            found: defaultdict[int, Spool] = defaultdict(Spool)
            for key, (kind, order, content) in items:
                found[key].add((kind, order), content)
            for key, spool in found.items():
                ids, bins, sums = [], [], None
                for (kind, _), content in spool:
                    if kind == 0:
                        for whole, a in zip((ids, bins), pickle.loads(content), strict=True):
                            whole.append(a)
                        continue
                    if not ids:
                        break
                    if sums is None:
                        ids, bins = [np.concatenate(ids)], np.concatenate(bins, axis=1)
                        sums = np.zeros(len(ids[0]))
                    tree = pickle.loads(content)
                    for lo in range(0, len(sums), ROWS_AT_ONCE):
                        sums[lo:lo + ROWS_AT_ONCE] += tree_shares(tree, bins[:, lo:lo + ROWS_AT_ONCE])
                if sums is not None:
                    yield key // groups, (ids[0].astype(np.int64) if key % groups == 0 else None, sums)

        def added(a: tuple, b: tuple) -> tuple:
            return a[0] if b[0] is None else b[0], a[1] + b[1]

        def opened(items: Iterator[tuple]) -> Iterator[tuple]:
            for _, (ids, sums) in items:
                for lo in range(0, len(ids), ROWS_AT_ONCE):
                    yield bytearray(ids[lo:lo + ROWS_AT_ONCE].tobytes()), bytearray(sums[lo:lo + ROWS_AT_ONCE].tobytes())

        def as_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for ids, sums in zip(batch["ids"], batch["sums"], strict=True):
                    yield pd.DataFrame({uid: np.frombuffer(ids, dtype=np.int64), f"p_{uid}": np.frombuffer(sums, dtype=np.float64) / trees})

        scored = dealt.partitionBy(blocks * groups, lambda k: k).mapPartitions(score).reduceByKey(added, blocks).mapPartitions(opened)
        shares = spark.createDataFrame(scored, "ids binary, sums binary").mapInPandas(as_rows, f"{uid} long, p_{uid} double")
        p = F.col(f"p_{uid}")
        return cut_lineage(kept.join(shares, uid)).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop(uid, f"p_{uid}")
