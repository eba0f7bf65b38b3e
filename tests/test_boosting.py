"""Histogram boosting against a plain booster, and both ways of growing against each other."""
import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from credrisk.operators import boosting as bo
from credrisk.operators import models as mdl
from credrisk.operators import smote as sm

SCHEMA = "id long, x array<double>, label int, weights array<float>"


def matrix(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 30, n), rng.normal(size=n).round(1), rng.integers(0, 2, n), np.full(n, 7.0), rng.normal(size=n)])
    y = (x[:, 0] / 10 + x[:, 1] + x[:, 2] * x[:, 4] + rng.normal(size=n) > 1.7).astype(int)
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = matrix()
    data = [(int(i) * 7919 - 10**6, x[i].tolist(), int(y[i]), [1.0, -1.0 if i % 5 == 0 else 1.0, (2.5 if y[i] else 1.0) if i % 5 else 0.0]) for i in range(len(x))]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def plain_boosting(x, y, w, cuts, trees, depth, rate, gamma):
    """Node by node, every feature and cut tried on the rows themselves."""
    margin = np.zeros(len(x))

    def grow(at, g, h, level):
        def score(s):
            return g[s].sum() ** 2 / (h[s].sum() + 1)
        best = (max(1e-6, gamma), None)
        if level < depth:
            for f, bounds in enumerate(cuts):
                for c in bounds:
                    left, right = at[x[at, f] <= c], at[x[at, f] > c]
                    if h[left].sum() >= 1 and h[right].sum() >= 1:
                        gain = score(left) + score(right) - score(at)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
        if best[1] is None:
            out[at] = -rate * g[at].sum() / (h[at].sum() + 1)
        else:
            for part in best[1]:
                grow(part, g, h, level + 1)

    for _ in range(trees):
        p, out = 1 / (1 + np.exp(-margin)), np.zeros(len(x))
        grow(np.arange(len(x)), w * (p - y), w * p * (1 - p), 0)
        margin += out
    return margin


@pytest.mark.parametrize("gamma", [0.0, 2.0])
def test_trees_equal_a_plain_booster(spark, rows, gamma):
    (forests, _), cuts = bo.boost(rows, [bo.Fit(0, trees=6, depth=3, rate=0.3, gamma=gamma)])
    x, y = matrix()
    assert cuts[3] == [] and cuts[2] == [0.0] and len(cuts[0]) == 29
    want = plain_boosting(x, y, np.ones(len(x)), cuts, 6, 3, 0.3, gamma)
    model = bo.BoostedTreesModel.of(forests[0], cuts)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").select("i", array_to_vector("v").alias("features"))
    got = {r.i: r.score for r in mdl.with_probability(model.transform(frame)).select("i", "score").collect()}
    assert np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-want)), atol=1e-9)
    importances = model.featureImportances.toArray()
    assert importances.sum() == pytest.approx(1) and importances[3] == 0


def test_both_ways_grow_the_same_trees(rows, monkeypatch):
    monkeypatch.setattr(bo, "KEEP_EVERY", 3)
    monkeypatch.setattr(bo, "CHECKPOINT_EVERY", 6)
    fits = [bo.Fit(1, trees=5, depth=4, rate=0.2, rows=0.7, columns=0.6), bo.Fit(2, trees=3, depth=2, rate=0.5), bo.Fit(1, trees=2, depth=1, gamma=1e9),
            bo.Fit(0, trees=4, depth=3, columns=0.4)]
    (one, judged), cuts = bo.boost(rows, fits)
    (many, judged_too), cuts_too = bo.boost(rows, fits, block_rows=60)
    assert cuts == cuts_too and (judged == judged_too).all()
    for a, b in zip(one, many, strict=True):
        assert [(t.feature, t.last_bin, t.child) for t in a] == [(t.feature, t.last_bin, t.child) for t in b]
        assert np.allclose(np.concatenate([t.value for t in a]), np.concatenate([t.value for t in b]))
    assert [len(f) for f in one] == [5, 3, 2, 4] and all(t.feature == [-1] for t in one[2])
    assert judged[0].sum() > 0 and judged[1].sum() == judged[3].sum() == 0
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in one[3])


def test_held_out_counts_and_drawn_rows(spark, rows):
    (forests, judged), cuts = bo.boost(rows, [bo.Fit(1, trees=10, depth=3)])
    x, y = matrix()
    model = bo.BoostedTreesModel.of(forests[0], cuts)
    nodes = [np.array(model.getOrDefault(p)) for p in (model.roots, model.feature, model.bound, model.child, model.value)]
    held = np.arange(len(x)) % 5 == 0
    said = bo.margins(x[held], *nodes) >= 0
    assert judged[0].tolist() == [(said & (y[held] == 1)).sum(), (said & (y[held] == 0)).sum(), (~said & (y[held] == 1)).sum()]
    ids = np.arange(20_000, dtype=np.int64).view(np.uint64)
    u, v = bo.uniform(ids, 1), bo.uniform(ids, 2)
    assert abs((u < 0.3).mean() - 0.3) < 0.02 and abs(np.corrcoef(u, v)[0, 1]) < 0.03


def test_model_is_saved_and_loaded_in_a_pipeline(spark, rows, tmp_path):
    (forests, _), cuts = bo.boost(rows, [bo.Fit(0, trees=3, depth=2)])
    PipelineModel(stages=[bo.BoostedTreesModel.of(forests[0], cuts)]).write().overwrite().save(str(tmp_path / "m"))
    frame = rows.select("id", array_to_vector("x").alias("features"))
    again = mdl.with_probability(PipelineModel.load(str(tmp_path / "m")).transform(frame))
    first = mdl.with_probability(bo.BoostedTreesModel.of(forests[0], cuts).transform(frame))
    assert first.exceptAll(again).count() == 0 and again.count() == 400
    assert again.limit(0).select("probability").count() == 0


def test_fewer_synthetic_rows_are_the_first_ones(spark):
    x, y = matrix(120)
    minority = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if y[i]], "ID long, v array<double>").select("ID", array_to_vector("v").alias("features"))
    n, lists = minority.count(), sm.knn_lists(minority)
    many = {(r.number, str(r.features)) for r in sm.synthetic_rows(minority, n, 2 * n + 7, lists).collect()}
    few = {(r.number, str(r.features)) for r in sm.synthetic_rows(minority, n, n - 3, lists).collect()}
    assert {k for k, _ in many} == set(range(1, 2 * n + 8)) and few == {(k, v) for k, v in many if k <= n - 3}


def test_siblings_from_their_parent_and_rows_split_over_tasks(spark, rows, monkeypatch):
    fits = [bo.Fit(1, trees=5, depth=4, rate=0.2, rows=0.7, columns=0.6), bo.Fit(2, trees=3, depth=3, rate=0.5)]
    (plain, judged), _ = bo.boost(rows, fits)
    drawn = bo.Drawn(np.arange(300), np.ones(300), np.ones(300), matrix()[0][:300, :1].T.astype(np.uint8))
    first = drawn.histogram(np.zeros(300, dtype=np.int16), 1, 30)
    monkeypatch.setattr(bo, "SIBLING_ROWS", 1)
    node = (matrix()[0][:300, 0] > 20).astype(np.int16)
    second = drawn.histogram(node, 2, 30, {"target": np.array([[0, 1]])})
    assert (second.sum(axis=1) == first[:, 0]).all() and second[0, 1].sum() == node.sum()
    # samples within four blocks grow in tasks although all rows together fill more
    monkeypatch.setattr(bo, "_grown_by_level", None)
    (same, judged_too), _ = bo.boost(rows, fits, block_rows=100)
    assert (judged == judged_too).all()
    for a, b in zip(plain, same, strict=True):
        assert [(t.feature, t.last_bin, t.child) for t in a] == [(t.feature, t.last_bin, t.child) for t in b]


def test_gradients_and_hessians_add_up_in_one_walk_in_the_rows_order():
    rng = np.random.default_rng(5)
    rows, node = rng.integers(0, 30, (4, 500)).astype(np.uint8), rng.integers(0, 6, 500).astype(np.int16)
    g, h = rng.normal(size=500), rng.random(500)
    for at in (None, np.flatnonzero(rng.random(500) < 0.5)):
        some = slice(None) if at is None else at
        found = bo.gradient_sums(rows, node[some], (g + 1j * h)[some], 6, 30, at)
        assert found.shape == (2, 6, 4, 30)
        for c in range(4):
            slot = node[some].astype(int) * 30 + rows[c][some]
            for sums, values in zip(found, (g, h), strict=True):
                assert (sums[:, c].ravel() == np.bincount(slot, weights=values[some], minlength=180)).all()


def test_neighbours_are_ranked_without_their_vectors(spark):
    pairs = spark.createDataFrame([(1, 0.5, 2, 1), (1, 0.5, 2, 1), (1, 0.2, 3, 4), (1, 0.9, 4, 1), (2, 0.5, 1, 1)], "vid long, d double, other long, m long")
    vectors = spark.createDataFrame([(i, [float(i), -1.0]) for i in range(1, 5)], "vid long, x array<double>")
    found = {r.vid: [(b.m, b.y) for b in r.best] for r in sm.nearest_vectors(pairs, vectors, 2).collect()}
    assert found == {1: [(4, [3.0, -1.0]), (1, [2.0, -1.0])], 2: [(1, [1.0, -1.0])]}


def test_packed_columns_have_the_sums_of_a_walk_per_column(monkeypatch):
    rng = np.random.default_rng(3)
    widths = np.array([2, 2, 30, 11, 2, 30, 1, 5])
    bins = np.stack([rng.integers(0, w, 20_000) for w in widths]).astype(np.uint8)
    packs = bo.packed(widths)
    assert sorted(c for p in packs for c in p) == list(range(8)) and len(packs) < 4 and all(np.prod(widths[p]) <= bo.PACK_CELLS for p in packs)
    g, h = rng.normal(size=20_000), rng.random(20_000)
    node = rng.integers(0, 2, 20_000).astype(np.int16)
    drawn, plain = (bo.Drawn(np.arange(20_000), g, h, bins, widths=w) for w in (widths, None))
    called = []
    monkeypatch.setattr(bo, "packed_sums", lambda *a, f=bo.packed_sums: called.append(1) or f(*a))
    for i, nodes in enumerate((1, 2)):
        order = {"target": np.array([[0, 1]])} if i else None
        own = node * i
        assert np.allclose(drawn.histogram(own, nodes, 30, order), plain.histogram(own, nodes, 30, order), atol=1e-9)
    gone = np.where(rng.random(20_000) < 0.1, -1, 0).astype(np.int16)
    assert np.allclose(drawn.histogram(gone, 1, 30), plain.histogram(gone, 1, 30), atol=1e-9)
    assert called and np.allclose(drawn.histogram(node, 64, 30), plain.histogram(node, 64, 30), atol=1e-9)


def test_fits_of_one_sample_share_tasks():
    fits = [bo.Fit(s, trees=t, depth=3) for s in (0, 1) for t in (50, 100, 300, 800, 50)]
    hands = bo.hands_of(fits, 6)
    assert sorted(k for h in hands for k in h) == list(range(10)) and 4 <= len(hands) < 10
    work = [sum(fits[k].trees for k in h) for h in hands]
    assert all(len({fits[k].sample for k in h}) == 1 for h in hands) and work == sorted(work, reverse=True) and max(work) == 800


def test_samples_beyond_a_search_s_blocks_grow_in_tasks(rows, monkeypatch):
    """300,000 rows took a Spark job per level before."""
    monkeypatch.setattr(bo, "_grown_by_level", None)
    assert bo.TASK_ROWS >= 2_000_000 > 4 * bo.BLOCK_ROWS
    many = rows.selectExpr("explode(sequence(1, 800)) AS k", "*").selectExpr("id * 1000 + k AS id", "x", "label", "weights")
    (forests, judged), cuts = bo.boost(many, [bo.Fit(0, trees=2, depth=2), bo.Fit(1, trees=1, depth=1)])
    x, y = matrix()
    want = plain_boosting(np.repeat(x, 800, axis=0), np.repeat(y, 800), np.ones(len(x) * 800), cuts, 2, 2, 0.3, 0.0)
    nodes = bo.BoostedTreesModel.of(forests[0], cuts)
    got = bo.margins(x, *[np.array(nodes.getOrDefault(p)) for p in (nodes.roots, nodes.feature, nodes.bound, nodes.child, nodes.value)])
    assert np.allclose(got, want[::800], atol=1e-9) and judged[1].sum() > 0


def test_boosted_trees_of_many_rows_are_mllibs(spark, monkeypatch, tmp_path):
    cfg = next(c for c in mdl.CONFIGS if c.name == "Gradient Boosting")
    x, y = matrix()
    x[:, [1, 4]] = x[:, [1, 4]].round()   # every value is a bin of both
    frame = spark.createDataFrame([(i, v.tolist(), int(y[i])) for i, v in enumerate(x)], "ID long, x array<double>, label int").select(
        "ID", array_to_vector("x").alias("features"), "label")
    small = {"maxIter": 12, "maxDepth": 3, "stepSize": 0.1}
    plain = mdl.fit_rows(cfg, frame, small)
    monkeypatch.setattr(mdl, "MLLIB_FOREST_ROWS", 100)
    model = mdl.fit_rows(cfg, frame, small)
    assert isinstance(model, bo.BoostedTreesModel) and not isinstance(plain, bo.BoostedTreesModel)
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    a, b, c = ({r.ID: r.score for r in mdl.with_probability(m.transform(frame)).collect()} for m in (plain, model, again))
    assert b == c and max(abs(a[k] - b[k]) for k in a) < 1e-9
    assert model.featureImportances.toArray() == pytest.approx(plain.featureImportances.toArray(), abs=1e-9)
    assert again.stages[0].featureImportances == model.featureImportances
