"""Model-side invariants: AUC floor, save → load identity, search, neighbour forest."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credrisk.operators import evaluation as ev
from credrisk.operators import models as mdl
from credrisk.operators import sampling as smp
from credrisk.operators import smote as sm
from credrisk.operators.ingest import feature_matrix
from credrisk.operators.prep import preparation
from credrisk.plans.catalog import featured
from credrisk.plans.evaluation_queries import _split
from credrisk.session import cut_lineage

SF = "/root/testdata/sf0.01"
BY_NAME = {c.name: c for c in mdl.CONFIGS}


@pytest.fixture(scope="module")
def data(spark):
    m = feature_matrix(featured(spark, SF, "train"))
    return cut_lineage(m.join(_split(spark, SF).select("ID", "split", "fold"), "ID"))


def test_logistic_auc_floor_and_persistence(spark, data, tmp_path):
    cfg = BY_NAME["Logistic Regression"]
    model = mdl.fit(cfg, smp.train_part(data))
    pred = mdl.predictions(model, smp.test_part(data), cfg)
    auc = ev.roc_auc(pred.withColumn("label", F.col("label").cast("int"))).first()["auc"]
    assert auc > 0.6
    model.write().overwrite().save(str(tmp_path / "lr"))
    again = mdl.predictions(PipelineModel.load(str(tmp_path / "lr")), smp.test_part(data), cfg)
    a = {r["ID"]: r["score"] for r in pred.collect()}
    b = {r["ID"]: r["score"] for r in again.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_weighted_tree_and_importances(spark, data):
    model = mdl.fit(BY_NAME["Decision Tree"], smp.train_part(data))
    prepared = PipelineModel(stages=model.stages[:-1]).transform(smp.train_part(data))
    imp = mdl.feature_importances(model, prepared, spark).toPandas()
    assert abs(imp.importance.sum() - 1.0) < 1e-4
    assert {"GENDER", "EDUCATION", "MARRIAGE", "PAY_0"} <= set(imp.feature)
    bare = prepared.select(F.col("features")).withMetadata("features", {})
    assert {f"feature_{i}" for i in range(3)} <= set(mdl.feature_importances(model, bare, spark).toPandas().feature)


def test_search_scores_infeasible_draws_zero(spark, data):
    small = {"trees": 5, "depth": 2, "rate": 0.1, "rows": 0.8, "columns": 0.8}
    draws = [{**small, "smote_ratio": 0.05}, {**small, "smote_ratio": 0.5}, {**small, "smote_ratio": 0.8}]
    train = smp.train_part(data)
    model, best, scores = mdl.random_search(BY_NAME["Tuned SMOTE XGBoost"], train, n_folds=2, draws=draws)
    assert best in draws[1:] and scores[0][1] == 0.0 and 0 < scores[1][1] <= 1
    assert model.transform(train).select("probability").first() is not None
    with pytest.raises(sm.InfeasibleRatio):
        mdl.random_search(BY_NAME["Tuned SMOTE XGBoost"], train, n_folds=2, draws=draws[:1])


def test_search_does_not_depend_on_how_rows_are_dealt(spark, data):
    draws = [{"trees": 4, "depth": 3, "rate": 0.3, "rows": 0.7, "columns": 0.7, "gamma": g} for g in (0.0, 1000.0)]
    train = smp.train_part(data)
    one, other = (mdl.random_search(BY_NAME["Tuned Weight XGBoost"], train, n_folds=2, draws=draws, block_rows=b) for b in (1 << 16, 200))
    assert one[1:] == other[1:] and one[2][0][1] != one[2][1][1]
    a, b = (mdl.with_probability(m.transform(train)).select("ID", "score").orderBy("ID").toPandas() for m in (one[0], other[0]))
    assert np.allclose(a.score, b.score)


def test_fold_weights_of_a_search(spark, data):
    train = smp.train_part(data)
    rows = cut_lineage(preparation("tree").fit(train).transform(train).select("ID", "features", "label", "fold"))
    every, samples = mdl.search_rows(BY_NAME["Tuned SMOTE XGBoost"], rows, 2, [0.01, 0.5, 0.9], 4)
    n = rows.groupBy("fold", "label").count().toPandas().set_index(["fold", "label"])["count"]
    sums = every.select(F.posexplode("weights").alias("s", "w"), "label").groupBy("s", "label", "w").count().toPandas()
    assert set(samples) == {(f, r) for f in (None, 0, 1, 2, 3, 4)[:3] for r in (0.5, 0.9)}
    for (fold, ratio), s in samples.items():
        inside = n if fold is None else n.drop(fold, level="fold")
        major = inside.xs(0, level="label").sum()
        got = {(r.label, r.w): r["count"] for _, r in sums[sums.s == s].iterrows()}
        assert got[0, 1.0] == major and got[1, 1.0] == int(ratio * major)
        assert sum(v for (_, w), v in got.items() if w < 0) == (0 if fold is None else n.loc[fold].sum())


def test_smote_l2_strength_counts_the_resampled_rows(spark, data):
    model = mdl.fit(BY_NAME["SMOTE Logistic Regression"], smp.train_part(data))
    train = smp.train_part(data)
    n_major = train.filter("label = 0").count()
    n = n_major + int(0.5 * n_major)
    assert model.stages[-1].getRegParam() == pytest.approx(1 / n)


def test_param_sampling_is_seeded_and_distinct():
    a = mdl.sample_param_maps(mdl.SMOTE_SEARCH, 20)
    b = mdl.sample_param_maps(mdl.SMOTE_SEARCH, 20)
    assert a == b and len({tuple(sorted(d.items())) for d in a}) == 20


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(40, 20))[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 20))


def test_neighbour_forest_recall_over_several_leaves(spark):
    x = clustered(3000)
    schema = T.StructType([T.StructField("features", VectorUDT())])
    frame = spark.createDataFrame([(Vectors.dense(v.tolist()),) for v in x], schema)
    got = {tuple(r["x"]): r["nn"] for r in sm.knn_lists(frame).collect()}
    hits = 0
    for i in range(0, 3000, 30):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        true = {tuple(x[j].tolist()) for j in np.argsort(d)[:5]}
        mine = [tuple(v) for v in got[tuple(x[i].tolist())]]
        assert len(mine) == 5 and [((np.array(v) - x[i]) ** 2).sum() for v in mine] == sorted(((np.array(v) - x[i]) ** 2).sum() for v in mine)
        hits += len(true & set(mine))
    assert hits / 500 >= 0.95


def squares_per_row(spark, x, trees=2, leaf_rows=200, sample=1000):
    """Sum of squared leaf sizes over the vectors: distances per vector and tree."""
    planted = sm.plant_forest(x[:sample], len(x), trees, leaf_rows, 1)
    at = sm.leaves(x, planted)
    frame = spark.createDataFrame(pd.DataFrame({"x": list(x), "vid": np.arange(len(x))}), "x array<double>, vid long")
    nodes = spark.createDataFrame(pd.DataFrame({"vid": np.tile(np.arange(len(x)), trees), "tree": np.repeat(np.arange(trees), len(x)), "leaf": at.T.ravel()}),
                                  "vid long, tree int, leaf long")
    placed = cut_lineage(frame.join(nodes, "vid").select("x", F.lit(1).cast("long").alias("m"), "vid", "tree", "leaf"))
    leaf = sm.grown(placed, planted, leaf_rows, 1).groupBy("tree", "leaf", "piece").count().toPandas()["count"]
    assert leaf.sum() == trees * len(x) and leaf.max() <= leaf_rows
    return (leaf.astype(float) ** 2).sum() / leaf.sum()


def test_neighbour_forest_work_per_row_does_not_grow(spark):
    work = [squares_per_row(spark, clustered(n, seed=n)) for n in (4000, 32_000, 256_000)]
    assert max(work) < 1.5 * min(work) and max(work) <= 200


def test_neighbour_forest_cuts_vectors_that_the_sample_never_saw(spark):
    far = np.zeros((6000, 20))
    far[:, 3] = 100 + np.arange(6000) * 1e-7        # one corner of the space, none of it in the sample
    assert squares_per_row(spark, np.concatenate([clustered(2000), far]), sample=500) <= 200


def test_neighbour_forest_recall_with_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(sm, "SAMPLE_ROWS", 200)
    monkeypatch.setattr(sm, "LEAF_ROWS", 100)
    test_neighbour_forest_recall_over_several_leaves(spark)


def test_null_labels_are_refused(spark):
    frame = spark.createDataFrame([(1, 0), (2, None)], "ID long, DEFAULT int")
    with pytest.raises(Exception, match="cannot stratify"):
        smp.stratified_split(frame).collect()


def test_all_thirteen_models_have_results_importances_and_registry(spark, monkeypatch, tmp_path):
    """The fits are replaced by one small tree, the searches by a fixed draw."""
    import __spark_entry__ as entry
    from credrisk.plans import model_queries as mq
    fit, tree = mdl.fit, mq.BY_NAME["Decision Tree"]
    monkeypatch.setattr(mq, "_MADE", {})
    monkeypatch.setattr(mq, "ensure_checkpoint_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(mdl, "fit", lambda cfg, train: fit(tree, train))
    monkeypatch.setattr(mdl, "random_search", lambda cfg, train: (fit(tree, train), {"max_depth": 6}, []))
    queries, names, smoke = entry.queries(), {c.name for c in mdl.CONFIGS}, "/root/testdata/sf0.001"
    rows = queries["results_all"](spark, smoke).collect()
    assert len(names) == 13 and {r.model for r in rows} == names
    assert {(r.model, r.name, r.value) for r in rows if r.kind == "best_param"} == {(c.name, "max_depth", "6") for c in mdl.CONFIGS if c.search}
    assert {r.model for r in queries["top_importances_all"](spark, smoke).collect()} == names
    assert {(r.model, r.status) for r in queries["model_registry_all"](spark, smoke).collect()} == {(n, "loaded") for n in names} | {("Missing Model", "failed")}
    assert [r.model for r in queries["failed_artifacts_all"](spark, smoke).collect()] == ["Missing Model"]


def test_neighbours_of_all_embeddings(spark, tmp_path):
    from credrisk.plans.catalog import QUERIES, load_all
    load_all()
    x = clustered(600).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(600, None), (601, [float("nan")] * 20), (602, [None] * 20), (603, [1.0] * 3), (604, x[0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["embedding_neighbours"](spark, str(tmp_path)).collect()
    assert len(got) == 600 and {r.n_neighbours for r in got} == {5}
