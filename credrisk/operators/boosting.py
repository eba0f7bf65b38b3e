"""Gradient-boosted trees on histograms, grown for many fits at once.

A randomized search fits hundreds of boosted models on parts of one matrix.  The matrix
is binned once (quantile cuts from one aggregate); every row carries one weight per *sample*
(a fold's training rows, with or without its synthetic rows), and its margin and tree
node for every fit.  Rows lie in blocks; one pass over the blocks sums gradients per (fit, node,
feature, bin), the sums are added up per fit on the executors, the best split of every node
comes back, and the next pass moves the rows and sums the next level.  So a
level of all fits costs one job, whatever the number of fits.  Where the rows of a sample
are few enough for one task (``TASK_ROWS``) a task takes some fits of a sample with its rows: the
sums are already whole, and the fits grow there with the same steps, without an exchange in between.

Objective, regularisation and sampling follow the boosting library the settings were
written for: logistic loss, leaf weight -G / (H + 1), least hessian 1 in a child, a split
needs a loss reduction above ``gamma`` summed over rows, rows are drawn per tree, columns
per tree.  A fit with ``squares`` follows MLlib's gradient-boosted trees instead: every tree fits the
residuals of the log loss of labels -1 and 1 by least squares, the first one the labels themselves at rate 1.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import RDD, TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SEED
from ..session import workers_find_package

BLOCK_ROWS = 1 << 16
TASK_ROWS = 1 << 21     # rows that one task takes to grow fits by itself (by estimate some 300 MB with what a fit adds)
TASK_BLOCKS = 4         # the same in blocks, where the size of a block is given
HANDS_PER_CORE = 3      # tasks per core that share out the fits of a search
SIBLING_ROWS = 1 << 14  # open rows from which a node's sums come from its parent's and its sibling's
PACK_CELLS = 1 << 12    # cells of columns that are summed together
PACK_COLUMNS = 6        # columns that are summed together at most
MAX_BINS = 64
LAMBDA = 1.0
MIN_HESSIAN = 1.0
LEAST_GAIN = 1e-6
KEEP_EVERY = 8          # rounds that are replayed on a block before its state is kept
CHECKPOINT_EVERY = 128  # rounds after which the lineage of the state is cut


@dataclass(frozen=True)
class Fit:
    """Settings of one model; ``sample`` says which weight of a row it uses."""

    sample: int
    trees: int = 100
    depth: int = 6
    rate: float = 0.3
    rows: float = 1.0
    columns: float = 1.0
    gamma: float = 0.0
    seed: int = SEED
    squares: bool = False

    @property
    def shrinkage(self) -> float:
        return 0.0 if self.squares else LAMBDA

    def gradients(self, margin: np.ndarray, label: np.ndarray, weight: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        if not self.squares:
            p = 1 / (1 + np.exp(-margin))
            return weight * (p - label), weight * p * (1 - p)
        sign = 2.0 * label - 1
        return -weight * (sign if first else 4 * sign / (1 + np.exp(2 * sign * margin))), weight


@dataclass
class Tree:
    """Nodes in breadth-first order: split feature (-1 for a leaf), last bin that goes left, first child, leaf value, gain."""

    feature: list[int] = field(default_factory=lambda: [-1])
    last_bin: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.last_bin, 0), (self.child, 0), (self.value, value), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1


def uniform(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) per row and salt (splitmix64), whatever block the row lies in."""
    with np.errstate(over="ignore"):
        z = ids + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


class Growth:
    """One fit's trees as they grow.  ``open_nodes`` are the nodes of the level in work; what a level
    decided is an *order* (feature, last bin, target, value) per open node, which blocks apply to their rows."""

    def __init__(self, fit: Fit, n_features: int):
        self.fit, self.n_features = fit, n_features
        self.trees: list[Tree] = []
        self.begin()

    def begin(self) -> None:
        self.level, self.tree = 0, Tree()
        self.open_nodes = [0]
        size = max(1, int(self.fit.columns * self.n_features))
        drawn = np.random.default_rng((self.fit.seed, len(self.trees))).permutation(self.n_features)[:size]
        self.columns = np.sort(drawn)

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.fit.trees

    def decide(self, best: dict[str, np.ndarray]) -> dict:
        """Take the best split of every open node; returns the order for the rows."""
        tree, nodes, least = self.tree, self.open_nodes, self.fit.shrinkage
        rate = 1.0 if self.fit.squares and not self.trees else self.fit.rate
        split = best["gain"] > max(LEAST_GAIN, self.fit.gamma)
        last = self.level + 1 == self.fit.depth
        target, value, grown = np.full((len(nodes), 2), -1), np.zeros((len(nodes), 2)), []
        for i, node in enumerate(nodes):
            if not split[i]:
                value[i] = tree.value[node] = -rate * best["g"][i] / (best["h"][i] + least)
                continue
            tree.feature[node], tree.last_bin[node] = int(self.columns[best["column"][i]]), int(best["bin"][i])
            tree.gain[node] = float(best["gain"][i])
            for side, (g, h) in enumerate(((best["gl"][i], best["hl"][i]), (best["g"][i] - best["gl"][i], best["h"][i] - best["hl"][i]))):
                child = tree.add(-rate * g / (h + least) if last else 0.0)
                if side == 0:
                    tree.child[node] = child
                if last:
                    value[i, side] = tree.value[child]
                else:
                    target[i, side] = len(grown)
                    grown.append(child)
        order = {"feature": np.array([tree.feature[n] for n in nodes]), "bin": np.array([tree.last_bin[n] for n in nodes]),
                 "target": target, "value": value, "ends": not grown}
        self.level, self.open_nodes = self.level + 1, grown
        if not grown:
            self.trees.append(self.tree)
            self.begin()
        return order


def best_splits(hist: np.ndarray, shrinkage: float = LAMBDA) -> dict[str, np.ndarray]:
    """Best split per node from gradient and hessian sums (2, nodes, columns, bins)."""
    total = hist[:, :, 0].sum(axis=2)
    left = hist.cumsum(axis=3)[..., :-1]
    right = total[:, :, None, None] - left
    score = lambda s: s[0] ** 2 / np.maximum(s[1] + shrinkage, 1e-300)
    gain = score(left) + score(right) - score(total)[:, None, None]
    gain[(left[1] < MIN_HESSIAN) | (right[1] < MIN_HESSIAN)] = -np.inf
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    rows = np.arange(len(gain))
    column, last_bin = np.divmod(at, gain.shape[2])
    return {"gain": flat[rows, at], "column": column, "bin": last_bin, "g": total[0], "h": total[1],
            "gl": left[0, rows, column, last_bin], "hl": left[1, rows, column, last_bin]}


def gradient_sums(rows: np.ndarray, node: np.ndarray, gh: np.ndarray, nodes: int, bins: int, at: np.ndarray | None = None) -> np.ndarray:
    """(2, nodes, columns, bins) sums of gradients and hessians (one complex number a row) over rows whose bins
    are ``rows`` (columns, rows), or over those of them at ``at``.  Both add up in one walk, in the rows' order."""
    base, out = node.astype(np.int64) * bins, np.zeros((len(rows), nodes * bins), dtype=np.complex128)
    slot = np.empty_like(base)
    for i, column in enumerate(rows):
        np.add.at(out[i], np.add(base, column if at is None else column.take(at, mode="clip"), out=slot), gh)
    return np.ascontiguousarray(out.view(np.float64).reshape(len(rows), nodes, bins, 2).transpose(3, 1, 0, 2))


def packed(widths: np.ndarray) -> list[list[int]]:
    """Columns put together whose numbers of bins multiply to ``PACK_CELLS`` at most, narrow ones first."""
    packs: list[list[int]] = []
    for c in np.argsort(widths, kind="stable").tolist():
        if packs and len(packs[-1]) < PACK_COLUMNS and np.prod(widths[packs[-1]]) * widths[c] <= PACK_CELLS:
            packs[-1].append(c)
        else:
            packs.append([c])
    return packs


def packed_sums(packs: list[tuple[list[int], np.ndarray]], widths: np.ndarray, node: np.ndarray, gh: np.ndarray, nodes: int, bins: int,
                at: np.ndarray | None = None) -> np.ndarray:
    """The sums of :func:`gradient_sums` but for rounding: a walk over the rows serves all columns of a pack (its columns
    and the rows' cells); the cells' sums are added up per column."""
    out = np.zeros((2, nodes, len(widths), bins))
    for columns, code in packs:
        shape = widths[columns]
        cells = int(np.prod(shape))
        slot = node.astype(np.int64) * cells
        slot += code if at is None else code.take(at, mode="clip")
        table = np.zeros(nodes * cells, dtype=np.complex128)
        np.add.at(table, slot, gh)
        for i, c in enumerate(columns):
            own = table.reshape(nodes, int(np.prod(shape[:i])), shape[i], -1).sum(axis=(1, 3))
            out[0, :, c, :shape[i]], out[1, :, c, :shape[i]] = own.real, own.imag
    return out


@dataclass
class Drawn:
    """Rows drawn for a tree: their gradients and hessians (real and imaginary part of ``gh``), which stay until
    a row reaches a leaf, their bins in the tree's columns, and the sums of the level before.  With ``widths``, the
    columns' numbers of bins, columns are packed while rows are many for the cells."""

    at: np.ndarray
    g: InitVar[np.ndarray]
    h: InitVar[np.ndarray]
    bins: np.ndarray
    sums: np.ndarray | None = None
    widths: np.ndarray | None = None
    gh: np.ndarray = field(init=False)
    packs: list[tuple[list[int], np.ndarray]] = field(init=False)

    def __post_init__(self, g: np.ndarray, h: np.ndarray) -> None:
        self.gh = np.empty(len(self.at), dtype=np.complex128)
        self.gh.real, self.gh.imag = g, h
        self.packs = []
        if self.widths is not None and len(self.at) >= 2 * PACK_CELLS:
            for columns in packed(self.widths):
                code = self.bins[columns[0]].astype(np.uint16)
                for c in columns[1:]:
                    code *= np.uint16(self.widths[c])
                    code += self.bins[c]
                self.packs.append((columns, code))

    def added(self, node: np.ndarray, gh: np.ndarray, nodes: int, bins: int, at: np.ndarray | None = None) -> np.ndarray:
        if self.packs and len(node) >= 2 * nodes * PACK_CELLS:
            return packed_sums(self.packs, self.widths, node, gh, nodes, bins, at)
        return gradient_sums(self.bins, node, gh, nodes, bins, at)

    def histogram(self, node_of: np.ndarray, nodes: int, bins: int, order: dict | None = None) -> np.ndarray:
        """Sums of the open nodes.  After an ``order`` the open nodes are pairs of siblings: where rows are
        many, only the smaller one is summed, the other is its parent's sums less these."""
        node = node_of.take(self.at)
        if len(node) and node.min() < 0:
            still = np.flatnonzero(node >= 0)
            self.at, self.gh, self.bins, node = self.at[still], self.gh[still], np.stack([b.take(still) for b in self.bins]), node[still]
            self.packs = [(columns, code.take(still)) for columns, code in self.packs]
        if order is None or self.sums is None or len(node) < SIBLING_ROWS:
            self.sums = self.added(node, self.gh, nodes, bins)
            return self.sums
        rows = np.bincount(node, minlength=nodes).reshape(-1, 2)
        smaller = np.arange(0, nodes, 2) + (rows[:, 1] < rows[:, 0])
        summed = np.flatnonzero(np.isin(np.arange(nodes), smaller).take(node))
        part = self.added(node.take(summed) >> 1, self.gh.take(summed), nodes // 2, bins, summed)
        parent = self.sums[:, order["target"][:, 0] >= 0]
        self.sums = np.empty((2, nodes, *part.shape[2:]))
        self.sums[:, smaller], self.sums[:, smaller ^ 1] = part, parent - part
        return self.sums


@dataclass
class Block:
    """Binned rows (a row of ``bins`` per feature), their weights per sample, and per fit their margins and open nodes (-1 in a leaf)."""

    ids: np.ndarray
    bins: np.ndarray
    label: np.ndarray
    weights: np.ndarray
    margin: np.ndarray
    node: np.ndarray

    @classmethod
    def of(cls, chunks: list[tuple], fits: int = 0) -> Block:
        """From (ids, bins, labels, weights) of :func:`binned`."""
        ids, bins, label, weights = (np.concatenate(part, axis=-1) for part in zip(*chunks, strict=True)) if len(chunks) > 1 else chunks[0]
        return cls(ids, bins, label, weights, np.zeros((fits, len(ids))), np.zeros((fits, len(ids)), dtype=np.int16))

    def for_fits(self, fits: int) -> Block:
        """The same rows for ``fits`` fits that begin."""
        n = len(self.ids)
        return replace(self, margin=np.zeros((fits, n)), node=np.zeros((fits, n), dtype=np.int16))

    def drawn(self, k: int, fit: Fit, tree: int, columns: np.ndarray, widths: np.ndarray | None = None) -> Drawn:
        """Training rows of fit ``k`` drawn for a tree and not yet in a leaf; ``widths`` has the numbers of bins of all features."""
        weight = self.weights[fit.sample]
        used = (weight > 0) & (self.node[k] >= 0)
        if fit.rows < 1:
            used &= uniform(self.ids, fit.seed * 1_000_003 + tree) < fit.rows
        at = np.flatnonzero(used)
        g, h = fit.gradients(self.margin[k, at], self.label[at], weight[at].astype(np.float64), tree == 0)
        return Drawn(at, g, h, np.stack([self.bins[c].take(at, mode="clip") for c in columns]),
                     widths=None if widths is None else widths[columns])

    def histogram(self, k: int, growth_view: tuple[Fit, int, np.ndarray, int], bins: int) -> np.ndarray:
        """(2, open nodes, columns, bins) of fit ``k``: gradients and hessians of its drawn training rows."""
        fit, tree, columns, nodes = growth_view
        return self.drawn(k, fit, tree, columns).histogram(self.node[k], nodes, bins)

    def apply(self, k: int, order: dict) -> None:
        """Move the rows of fit ``k`` by the order of a level; rows that reach a leaf add its value."""
        all_nodes, n = self.node[k], self.node.shape[1]
        at = np.flatnonzero(all_nodes >= 0)
        node = all_nodes if len(at) == n else all_nodes.take(at)
        cell = (np.maximum(order["feature"], 0) * n).take(node)
        cell += at
        way = node.astype(np.int64) * 2
        way += self.bins.reshape(-1).take(cell, mode="clip") > order["bin"].take(node)
        if (order["target"] < 0).any():
            self.margin[k, at] += np.where(order["target"] < 0, order["value"], 0.0).ravel().take(way)
        self.node[k, at] = order["target"].ravel().take(way)
        if order["ends"]:
            self.node[k] = 0

    def judged(self, k: int, fit: Fit) -> np.ndarray:
        """tp, fp, fn at probability 0.5 over the rows held out of the fit (weight below zero)."""
        held = self.weights[fit.sample] < 0
        said, true = self.margin[k, held] >= 0, self.label[held] == 1
        return np.array([(said & true).sum(), (said & ~true).sum(), (~said & true).sum()])


def cut_points(rows: DataFrame, max_bins: int = MAX_BINS) -> list[list[float]]:
    """Upper bounds of the bins of every feature but the last bin, from one sketch aggregate."""
    probs = [k / max_bins for k in range(1, max_bins)]
    size = rows.select(F.size("x").alias("n")).first()
    if size is None:
        raise ValueError("no rows to bin")
    sketched = rows.agg(*[F.percentile_approx(F.col("x")[i], probs, 10_000).alias(f"c{i}") for i in range(size.n)],
                        *[F.max(F.col("x")[i]).alias(f"m{i}") for i in range(size.n)]).first()
    return [sorted({c for c in sketched[f"c{i}"] if c < sketched[f"m{i}"]}) for i in range(size.n)]


def binned(rows: DataFrame, cuts: list[list[float]], deal) -> RDD:
    """``deal`` of rows (id, x, label, weights) as chunks (ids, bins, labels, weights): it yields (number, chunk).
    Returns (number, (order, pickled chunk)); the order follows the rows'."""
    bounds = [np.array(c) for c in cuts]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(b for b in batches if len(b)):
            x, weights = np.stack(batch["x"].to_numpy()), np.stack(batch["weights"].to_numpy()).astype(np.float32)
            bins = np.stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(bounds)]).astype(np.uint8)
            chunk = (batch["id"].to_numpy().astype(np.int64).view(np.uint64), bins, batch["label"].to_numpy().astype(np.float64),
                     np.ascontiguousarray(weights.T))
            for number, piece in deal(chunk):
                yield pd.DataFrame({"number": [number], "at": [part + i], "chunk": [pickle.dumps(piece, protocol=5)]})

    out = rows.select("id", "x", F.col("label").cast("double").alias("label"), "weights").mapInPandas(place, "number long, at long, chunk binary")
    return out.rdd.map(lambda r: (r[0], (r[1], bytes(r[2]))))


def in_order(chunks: list[tuple]) -> list[tuple]:
    return [pickle.loads(c) for _, c in sorted(chunks, key=lambda c: c[0])]


def joined(chunks: list[tuple]) -> list[np.ndarray]:
    """The arrays of all chunks end to end, in order.  ``chunks`` is emptied on the way, so the rows are held once."""
    chunks.sort(key=lambda c: c[0], reverse=True)
    counts = [len(pickle.loads(c)[0]) for _, c in chunks]
    out, done = [], 0
    while chunks:
        arrays = pickle.loads(chunks.pop()[1])
        out = out or [np.empty((*a.shape[:-1], sum(counts)), dtype=a.dtype) for a in arrays]
        for whole, a in zip(out, arrays, strict=True):
            whole[..., done:done + a.shape[-1]] = a
        done += len(arrays[0])
    return out


def hands_of(fits: list[Fit], tasks: int) -> list[list[int]]:
    """Fits shared out among some ``tasks`` tasks, each with fits of one sample; the longest work first."""
    work = [f.trees * f.depth for f in fits]
    most, hands = max(max(work), sum(work) / tasks), []
    for k in sorted(range(len(fits)), key=lambda k: -work[k]):
        fitting = [h for h in hands if fits[h[0]].sample == fits[k].sample and sum(work[i] for i in h) + work[k] <= most]
        if fitting:
            fitting[0].append(k)
        else:
            hands.append([k])
    return sorted(hands, key=lambda h: -sum(work[i] for i in h))


def boost(rows: DataFrame, fits: list[Fit], max_bins: int = MAX_BINS, block_rows: int | None = None) -> tuple[list[list[Tree]], np.ndarray, list[list[float]]]:
    """Grow all ``fits`` on rows (id long, x array<double>, label, weights array<float>).

    ``weights`` has one entry per sample: above zero for training rows, below zero for
    rows that are only judged, zero for others.  Returns the trees per fit, (tp, fp, fn) per
    fit over its judged rows, and the cut points.
    """
    task_rows, block_rows = TASK_BLOCKS * block_rows if block_rows else TASK_ROWS, block_rows or BLOCK_ROWS
    workers_find_package(rows.sparkSession)
    context = rows.sparkSession.sparkContext
    cuts = cut_points(rows, max_bins)
    bins, n_features = max(1, *map(len, cuts)) + 1, len(cuts)
    n_samples = max(f.sample for f in fits) + 1
    sizes = rows.agg(F.count(F.lit(1)), *[F.count_if(F.col("weights")[s] != 0) for s in range(n_samples)]).first()
    cores = max(1, context.defaultParallelism)
    if max(sizes[1:]) <= task_rows:
        return _grown_in_tasks(rows, cuts, fits, hands_of(fits, HANDS_PER_CORE * cores), n_features, bins), cuts
    # the longest fits first, dealt out evenly
    order, blocks = sorted(range(len(fits)), key=lambda k: -fits[k].trees * fits[k].depth), -(-sizes[0] // block_rows)
    groups = 1 if blocks >= cores else min(len(fits), -(-cores // blocks))
    dealt = [[k for i, k in enumerate(order) if i % groups == g] for g in range(groups)]

    def by_block(chunk: tuple) -> Iterator[tuple[int, tuple]]:
        block = chunk[0].view(np.int64) % blocks
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            yield int(b), tuple(np.ascontiguousarray(part[..., at]) for part in chunk)

    def dealt_out(item: tuple) -> Iterator[tuple]:
        block = Block.of(in_order(list(item[1])))
        return (((item[0], g), (item[0], g, block.for_fits(len(dealt[g])))) for g in range(groups))

    state = binned(rows, cuts, by_block).groupByKey(blocks).flatMap(dealt_out)
    # a pass is short: a task takes several blocks, so that starting tasks does not outweigh it
    state = state.partitionBy(min(blocks * groups, cores), lambda key: key[0] * groups + key[1]).values()
    return _grown_by_level(state, fits, dealt, n_features, bins, cores), cuts


def _grown_in_tasks(rows: DataFrame, cuts: list[list[float]], fits: list[Fit], hands: list[list[int]], n_features: int, bins: int):
    """Every task holds all rows of its fits' sample, so the sums of a level are whole where they are made."""
    samples, widths = [fits[hand[0]].sample for hand in hands], np.array([len(c) + 1 for c in cuts])

    def by_hand(chunk: tuple) -> Iterator[tuple[int, tuple]]:
        ids, binned_rows, label, weights = chunk
        at = {s: np.flatnonzero(weights[s]) for s in set(samples)}
        pieces = {s: (ids[i], binned_rows[:, i], label[i].astype(np.int8), weights[s, i][None]) for s, i in at.items()}
        return ((number, pieces[s]) for number, s in enumerate(samples))

    def grow(items: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int, list[Tree], np.ndarray]]:
        chunks: dict[int, list] = {}
        for number, chunk in items:
            chunks.setdefault(number, []).append(chunk)
        for number in list(chunks):
            block = Block.of([joined(chunks.pop(number))], 1)
            for k in hands[number]:
                fit, block = replace(fits[k], sample=0), block.for_fits(1)
                growth, step = Growth(fit, n_features), None
                while not growth.done:
                    if growth.level == 0:
                        drawn, step = block.drawn(0, fit, len(growth.trees), growth.columns, widths), None
                    step = growth.decide(best_splits(drawn.histogram(block.node[0], len(growth.open_nodes), bins, step), fit.shrinkage))
                    block.apply(0, step)
                yield k, growth.trees, block.judged(0, fit)

    state = binned(rows, cuts, by_hand).partitionBy(len(hands), lambda number: number)
    found = {number: (trees, judged) for number, trees, judged in state.mapPartitions(grow).collect()}
    return [found[k][0] for k in range(len(fits))], np.array([found[k][1] for k in range(len(fits))])


def _grown_by_level(state: RDD, fits: list[Fit], dealt: list[list[int]], n_features: int, bins: int, cores: int):
    """One job per level of all fits; the state is kept every few rounds and replayed in between."""
    growths = [Growth(f, n_features) for f in fits]
    state = state.persist()
    pending: list[dict[int, dict]] = []
    rounds = 0

    def moved(item, orders):
        i, g, block = item
        for step in orders:
            for k, number in enumerate(dealt[g]):
                if number in step:
                    block.apply(k, step[number])
        return i, g, block

    while any(not g.done for g in growths):
        views = {k: (g.fit, len(g.trees), g.columns, len(g.open_nodes)) for k, g in enumerate(growths) if not g.done}
        orders = list(pending)

        def sums(items, orders=orders, views=views):
            for item in items:
                _, g, block = moved(item, orders)
                for k, number in enumerate(dealt[g]):
                    if number in views:
                        yield number, block.histogram(k, views[number], bins)

        found = (state.mapPartitions(sums).reduceByKey(np.add, min(cores, len(views)))
                 .map(lambda item: (item[0], best_splits(item[1], fits[item[0]].shrinkage))).collect())
        pending.append({number: growths[number].decide(best) for number, best in found})
        rounds += 1
        if len(pending) >= KEEP_EVERY:
            older, orders = state, list(pending)
            state = older.map(lambda item, orders=orders: moved(item, orders)).persist()
            if rounds % CHECKPOINT_EVERY < KEEP_EVERY:
                state.checkpoint()
            state.count()
            older.unpersist()
            pending = []

    def judge(item, orders=list(pending)):
        _, g, block = moved(item, orders)
        return [(number, block.judged(k, fits[number])) for k, number in enumerate(dealt[g])]

    judged = dict(state.flatMap(judge).reduceByKey(np.add).collect())
    state.unpersist()
    return [g.trees for g in growths], np.array([judged[k] for k in range(len(fits))])


class BoostedTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as one list of nodes; adds ``probability`` (a vector of both classes)."""

    roots = Param(Params._dummy(), "roots", "first node of every tree", TypeConverters.toListInt)
    feature = Param(Params._dummy(), "feature", "split feature, -1 in a leaf", TypeConverters.toListInt)
    bound = Param(Params._dummy(), "bound", "values up to it go left", TypeConverters.toListFloat)
    child = Param(Params._dummy(), "child", "left child; the right one follows it", TypeConverters.toListInt)
    value = Param(Params._dummy(), "value", "leaf value", TypeConverters.toListFloat)
    gain = Param(Params._dummy(), "gain", "loss reduction of the split", TypeConverters.toListFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    squares = Param(Params._dummy(), "squares", "whether margins are half the log odds and importances MLlib's", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(squares=False)

    @classmethod
    def of(cls, trees: list[Tree], cuts: list[list[float]], squares: bool = False) -> BoostedTreesModel:
        model, roots, columns, offset = cls(), [], {c: [] for c in ("feature", "bound", "child", "value", "gain")}, 0
        for t in trees:
            roots.append(offset)
            columns["feature"] += t.feature
            columns["bound"] += [cuts[f][b] if f >= 0 else 0.0 for f, b in zip(t.feature, t.last_bin, strict=True)]
            columns["child"] += [offset + c for c in t.child]
            columns["value"] += t.value
            columns["gain"] += t.gain
            offset += len(t.feature)
        return model._set(roots=roots, size=len(cuts), squares=squares, **columns)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name that MLlib's models use
        """Mean loss reduction of a feature's splits, as shares of one; with ``squares`` their sum."""
        total, count = np.zeros(self.getOrDefault(self.size)), np.zeros(self.getOrDefault(self.size))
        for f, g in zip(self.getOrDefault(self.feature), self.getOrDefault(self.gain), strict=True):
            if f >= 0:
                total[f] += g
                count[f] += 1
        mean = total / (1 if self.getOrDefault(self.squares) else np.maximum(count, 1))
        return DenseVector(mean / mean.sum() if mean.sum() else mean)

    def _transform(self, df: DataFrame) -> DataFrame:
        workers_find_package(df.sparkSession)
        nodes = [np.array(self.getOrDefault(p)) for p in (self.roots, self.feature, self.bound, self.child, self.value)]
        shared, times = df.sparkSession.sparkContext.broadcast(nodes), 2.0 if self.getOrDefault(self.squares) else 1.0

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-times * margins(np.stack(x.to_numpy()), *shared.value))) if len(x) else [], dtype="float64")

        p = f"p_{uuid.uuid4().hex}"
        return df.withColumn(p, probability(vector_to_array("features"))).withColumn(
            "probability", array_to_vector(F.array(1 - F.col(p), F.col(p)))).drop(p)


def margins(x: np.ndarray, roots: np.ndarray, feature: np.ndarray, bound: np.ndarray, child: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum of the leaf values that each row reaches."""
    out = np.zeros(len(x))
    for root in roots:
        node = np.full(len(x), root)
        inner = np.flatnonzero(feature[node] >= 0)
        while len(inner):
            at = node[inner]
            node[inner] = child[at] + (x[inner, feature[at]] > bound[at])
            inner = inner[feature[node[inner]] >= 0]
        out += value[node]
    return out
