"""The forest that grows in tasks: its trees, scores, importances and persistence."""
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from credrisk.operators import forest as fo
from credrisk.operators import models as mdl


def matrix(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.normal(size=n), rng.integers(0, 2, n), np.full(n, 7.0), rng.normal(size=n)])
    return x, (x[:, 0] / 4 + x[:, 1] + x[:, 2] * x[:, 4] + 0.3 * rng.normal(size=n) > 1.7).astype(int)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = matrix()
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(len(x))], "ID long, v array<double>, label int").select(
        "ID", array_to_vector("v").alias("features"), "label").repartition(3)


def test_a_tree_ends_in_pure_leaves_or_where_nothing_splits():
    x, y = matrix(300)
    bins = np.stack([np.searchsorted(np.quantile(c, np.arange(1, 32) / 32), c) for c in x.T]).astype(np.uint8)
    tree = fo.grow_tree(bins, y.astype(np.int8), np.ones(300), 32, 30, np.random.default_rng(1))
    assert (tree["feature"] != 3).all() and tree["feature"][0] >= 0 and len(tree["feature"]) == 2 * (tree["feature"] >= 0).sum() + 1
    assert (np.abs(fo.tree_shares(tree, bins) - y) < 0.5).mean() > 0.95
    stump = fo.grow_tree(bins, y.astype(np.int8), np.ones(300), 32, 1, np.random.default_rng(1))
    side = bins[stump["feature"][0]] > stump["bin"][0]
    assert stump["share"][1:].tolist() == pytest.approx([y[~side].mean(), y[side].mean()])


def test_forest_of_many_rows_grows_in_tasks_and_scores_like_mllibs(spark, rows, tmp_path, monkeypatch):
    cfg = next(c for c in mdl.CONFIGS if c.name == "Weight Random Forest")
    monkeypatch.setattr(mdl, "FOREST_TREES", 30)
    plain = mdl.fit_rows(cfg, rows)
    monkeypatch.setattr(mdl, "MLLIB_FOREST_ROWS", 1000)
    model = mdl.fit_rows(cfg, rows)
    assert isinstance(model, fo.ForestModel) and not isinstance(plain, fo.ForestModel) and model.table.count() == 30
    assert model.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=0.06)
    x, y = matrix(800, seed=5)
    test = spark.createDataFrame([(i % 700, v.tolist()) for i, v in enumerate(x)], "ID long, v array<double>").select("ID", "v", array_to_vector("v").alias("features"))
    monkeypatch.setattr(fo, "BLOCK_ROWS", 300)

    def scores(m):
        got = {tuple(r.v): r.score for r in mdl.with_probability(m.transform(test)).select("v", "score").collect()}
        return np.array([got[tuple(v)] for v in x.tolist()])
    a, b = scores(model), scores(plain)
    assert np.corrcoef(a, b)[0, 1] > 0.95 and ((a > 0.5) == y).mean() > ((b > 0.5) == y).mean() - 0.03
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "f"))
    again = PipelineModel.load(str(tmp_path / "f"))
    assert np.allclose(scores(again), a) and again.stages[0].featureImportances == model.featureImportances
    assert again.transform(test.limit(0)).select("probability").count() == 0
    assert again.transform(test).count() == 800


def test_rows_are_drawn_poisson_times():
    times = fo.drawn_times(np.arange(100_000, dtype=np.uint64), 3, 42)
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03 and (times != fo.drawn_times(np.arange(100_000, dtype=np.uint64), 4, 42)).any()


def test_rows_of_a_level_come_some_at_a_time(monkeypatch):
    x, y = matrix(900)
    bins = np.stack([np.searchsorted(np.quantile(c, np.arange(1, 32) / 32), c) for c in x.T]).astype(np.uint8)
    weight = np.random.default_rng(2).poisson(1, 900).astype(float)
    whole = fo.grow_tree(bins, y.astype(np.int8), weight, 32, 30, np.random.default_rng(1))
    drawn = np.flatnonzero(weight)
    monkeypatch.setattr(fo, "ROWS_AT_ONCE", 7)
    for other in (fo.grow_tree(bins, y.astype(np.int8), weight, 32, 30, np.random.default_rng(1)),
                  fo.grow_tree(bins[:, drawn], y[drawn].astype(np.int8), weight[drawn], 32, 30, np.random.default_rng(1))):
        assert all((whole[k] == other[k]).all() for k in whole)
    assert (np.abs(fo.tree_shares(whole, bins[:, drawn]) - y[drawn]) < 0.5).mean() > 0.95


def test_a_task_keeps_its_rows_in_a_file():
    spool = fo.Spool()
    for key in (3, 1, 2):
        spool.add((key,), bytes([key] * key))
    assert [(k, len(c), set(c)) for k, c in spool] == [((1,), 1, {1}), ((2,), 2, {2}), ((3,), 3, {3})]
    a = fo.mapped((5, 2), np.uint8)
    a[:] = 7
    assert isinstance(a.base, np.memmap) and a.sum() == 70 and fo.mapped((0, 2), np.uint8).shape == (0, 2)
