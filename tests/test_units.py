"""Inline unit cases (FIXTURES.md §4) and invariants of the custom operators."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credrisk.functions.features import with_features
from credrisk.functions.recode import age_group, risk_tier
from credrisk.operators import evaluation as ev
from credrisk.operators import leaderboard as lb
from credrisk.operators.association import corr_matrix
from credrisk.operators.ordered import exact_quantiles, running_sums
from credrisk.operators.prep import one_hot_stages
from credrisk.operators.sampling import stratified_split
from credrisk.operators.smote import smote
from credrisk.schema import BILL_COLS, CLIENT_RAW, PAY_AMT_COLS, PAY_COLS
from credrisk.operators.ingest import ingest


def client_rows(spark, **overrides):
    base = {f.name: 0 for f in CLIENT_RAW.fields}
    base.update({"ID": 1, "LIMIT_BAL": 100, "SEX": 1, "EDUCATION": 1, "MARRIAGE": 1, "AGE": 30})
    rows = []
    for i, o in enumerate(overrides.get("rows", [{}])):
        r = dict(base, ID=i + 1)
        r.update(o)
        rows.append(tuple(r[f.name] for f in CLIENT_RAW.fields))
    return ingest(spark.createDataFrame(rows, CLIENT_RAW))


def feats(spark, variant, **row):
    return with_features(client_rows(spark, rows=[row]), variant).first()


def test_negative_bill_total(spark):
    row = {"BILL_AMT1": -500, "PAY_AMT1": 100}
    assert feats(spark, "train", **row)["PAY_RATIO"] == pytest.approx(-0.2)
    assert feats(spark, "dash", **row)["PAY_RATIO"] == 0.0
    assert feats(spark, "score", **row)["PAY_RATIO"] == 0.0


def test_zero_limit_gives_zero_utilization(spark):
    for v in ("train", "dash", "score"):
        assert feats(spark, v, LIMIT_BAL=0, BILL_AMT1=900)["UTIL_RATE"] == 0.0


def test_null_bill_gives_zero_not_clip_bound(spark):
    assert feats(spark, "train", BILL_AMT1=None, LIMIT_BAL=100)["UTIL_RATE"] == 0.0


def test_clip_edges(spark):
    hi = {"PAY_AMT1": 700, "BILL_AMT1": 100}
    lo = {"PAY_AMT1": -900, "BILL_AMT1": 100}
    assert feats(spark, "train", **hi)["PAY_RATIO"] == 5.0
    assert feats(spark, "train", **lo)["PAY_RATIO"] == -2.0
    assert feats(spark, "dash", **hi)["PAY_RATIO"] == 5.0
    assert feats(spark, "dash", **lo)["PAY_RATIO"] == 0.0


def test_all_pay_null(spark):
    r = feats(spark, "train", **{c: None for c in PAY_COLS})
    assert r["AVG_PAY_STATUS"] is None and r["MAX_PAY_DELAY"] is None and r["CONSEC_LATE"] == 0


def test_late_count(spark):
    r = feats(spark, "train", **dict(zip(PAY_COLS, [2, 0, 1, -1, 0, 3])))
    assert r["CONSEC_LATE"] == 3 and r["MAX_PAY_DELAY"] == 3
    assert r["AVG_PAY_STATUS"] == pytest.approx(5 / 6)


def test_age_bins(spark):
    df = spark.createDataFrame([(a,) for a in [20, 21, 25, 26, 60, 61, 80, 81]], "AGE int")
    got = [r[0] for r in df.select(age_group("AGE")).collect()]
    assert got == [None, "21-25", "21-25", "26-30", "51-60", "60+", "60+", None]


def test_unseen_category_is_all_zeros(spark):
    from pyspark.ml.functions import vector_to_array
    train = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 3)], "GENDER int, EDUCATION int, MARRIAGE int")
    apply = spark.createDataFrame([(9, 1, 1)], "GENDER int, EDUCATION int, MARRIAGE int")
    idx, ohe = one_hot_stages()
    im = idx.fit(train)
    om = ohe.fit(im.transform(train))
    out = om.transform(im.transform(apply)).select(vector_to_array("cat__GENDER").alias("v")).first()["v"]
    assert len(out) == 3 and sum(out) == 0


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "score double, label int")


def test_tied_scores_auc(spark):
    auc = ev.roc_auc(scores(spark, [(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)])).first()["auc"]
    assert auc == pytest.approx(0.875)


def test_no_predicted_positive(spark):
    m = ev.metrics_from_counts(ev.confusion_counts(scores(spark, [(0.1, 1), (0.1, 0)]), [0.5])).first()
    assert m["precision"] == 0 and m["recall"] == 0 and m["f1"] == 0


def test_one_class_label(spark):
    s = scores(spark, [(0.2, 0), (0.7, 0)])
    assert ev.roc_auc(s).first()["auc"] is None
    assert ev.metrics_from_counts(ev.confusion_counts(s, [0.5])).first()["accuracy"] == 0.5


def test_tiers(spark):
    df = spark.createDataFrame([(p,) for p in [14.99, 15.0, 34.99, 35.0, 59.99, 60.0]], "pct double")
    got = [r[0] for r in df.select(risk_tier("pct")).collect()]
    assert got == ["LOW RISK", "MODERATE RISK", "MODERATE RISK", "HIGH RISK", "HIGH RISK", "CRITICAL RISK"]


def test_leaderboard_key_mismatch(spark):
    board = spark.createDataFrame([("A", 0.8), ("B", 0.7)], "model string, auc double")
    cm = spark.createDataFrame([("A", 5, 1, 2, 3)], "model string, tn long, fp long, fn long, tp long")
    rows = {r["model"]: r for r in lb.leaderboard(board, cm).collect()}
    assert rows["A"]["caught_defaulters"] == "3 / 5" and rows["A"]["false_alarms"] == "1"
    assert rows["B"]["caught_defaulters"] == "N/A" and rows["B"]["false_alarms"] == "N/A"


SCHEMA = T.StructType([T.StructField("ID", T.LongType()), T.StructField("features", VectorUDT()),
                       T.StructField("label", T.IntegerType())])


def test_smote_counts_and_convexity(spark):
    rng = np.random.default_rng(7)
    mins = rng.normal(size=(10, 3))
    rows = [(i, Vectors.dense(mins[i].tolist()), 1) for i in range(10)]
    rows += [(100 + i, Vectors.dense(rng.normal(size=3).tolist()), 0) for i in range(40)]
    out = smote(spark.createDataFrame(rows, SCHEMA), 0.5).toPandas()
    new = out[out.synthetic]
    assert len(new) == 10 and (new.label == 1).all()
    for f in new.features:
        x = f.toArray()
        found = False
        for i in range(10):
            d = np.sqrt(((mins - mins[i]) ** 2).sum(1))
            for j in np.argsort(d)[1:6]:
                v = mins[j] - mins[i]
                lam = np.dot(x - mins[i], v) / np.dot(v, v)
                found |= bool(0 <= lam <= 1 and np.allclose(mins[i] + lam * v, x))
        assert found


def test_smote_duplicates_use_self_copies(spark):
    rows = [(i, Vectors.dense([1.0, 1.0]), 1) for i in range(8)] + [(50, Vectors.dense([5.0, 5.0]), 1)]
    rows += [(100 + i, Vectors.dense([float(i), 0.0]), 0) for i in range(40)]
    out = smote(spark.createDataFrame(rows, SCHEMA), 0.5).toPandas()
    new = out[out.synthetic]
    assert len(new) == 11
    # [1,1] repeats 8 times (> k): its neighbours are its own copies, so its
    # synthetic rows equal it; [5,5]'s neighbours are copies of [1,1]
    for f in new.features:
        x = f.toArray()
        assert x[0] == pytest.approx(x[1]) and 1.0 - 1e-9 <= x[0] <= 5.0 + 1e-9


def test_smote_below_current_ratio_errors(spark):
    rows = [(i, Vectors.dense([float(i)]), 1) for i in range(10)] + [(100 + i, Vectors.dense([float(i)]), 0) for i in range(20)]
    with pytest.raises(ValueError):
        smote(spark.createDataFrame(rows, SCHEMA), 0.3)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "x int, y double")
    r = {(a["x"], a["y"]): a["r"] for a in corr_matrix(df, ["x", "y"]).collect()}
    assert r[("x", "y")] is None and r[("y", "y")] == 1.0


def test_auc_equals_mllib_evaluator(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(y * 0.3 + rng.random(400) * 0.7, 0, 1), 2)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    mine = ev.roc_auc(df, places=9).first()["auc"]
    mllib = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(
        df.withColumn("label", F.col("label").cast("double")))
    assert mine == pytest.approx(mllib, abs=1e-9)


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.integers(0, 1000, 600), np.full(300, 77)]).astype(float)
    df = spark.createDataFrame([("v", float(x)) for x in vals], "variable string, value double")
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, ["variable"], "value", [0.1, 0.25, 0.5, 0.9]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(vals, q))


def test_running_sums_match_cumsum(spark):
    rng = np.random.default_rng(9)
    keys = rng.permutation(500).astype(float)
    w = rng.integers(1, 5, 500)
    df = spark.createDataFrame([(float(k), int(x)) for k, x in zip(keys, w)], "k double, w long")
    out = running_sums(df, [("k", False)], ["w"], n_buckets=7).toPandas().sort_values("k", ascending=False)
    assert (out["cum_w"].to_numpy() == np.cumsum(out["w"].to_numpy())).all()


def test_stratified_split_invariants(spark):
    rows = [(i, int(i % 4 == 0)) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "ID long, DEFAULT int")
    out = stratified_split(df).toPandas()
    assert len(out) == 1000 and out.ID.is_unique
    test = out[out.split == "test"]
    assert (test.DEFAULT == 1).sum() == 50 and (test.DEFAULT == 0).sum() == 150
    folds = out[out.split == "train"].groupby(["fold", "DEFAULT"]).size()
    assert folds.groupby("DEFAULT").sum().to_dict() == {0: 600, 1: 200}
    assert set(out[out.split == "train"].fold) == {0, 1, 2, 3, 4}
    for _, g in out[out.split == "train"].groupby("DEFAULT"):
        c = g.groupby("fold").size()
        assert c.max() - c.min() <= 1


def test_read_optional_missing_path(spark, tmp_path):
    from credrisk.sources.io import LEADERBOARD, read_optional
    assert read_optional(spark, str(tmp_path / "absent"), LEADERBOARD).count() == 0


def test_results_document_round_trip(spark, tmp_path):
    from credrisk.sources.io import RESULTS, read_results, write_results
    row = Row(model="m", auc=0.8, f1=0.5, fpr=[0.0, 1.0], tpr=[0.0, 1.0], prec=[1.0], rec=[0.0],
              cm=[[1, 2], [3, 4]], feature_importances={"AGE": 0.4}, best_params={"maxDepth": "3"})
    df = spark.createDataFrame([row], RESULTS)
    write_results(df, str(tmp_path / "res"))
    back = read_results(spark, str(tmp_path / "res")).first()
    assert back["cm"] == [[1, 2], [3, 4]] and back["feature_importances"] == {"AGE": 0.4}


def test_results_reader_keeps_corrupt_lines(spark, tmp_path):
    from credrisk.sources.io import read_results
    (tmp_path / "res").mkdir()
    (tmp_path / "res" / "part.json").write_text('{"model": "a", "auc": 0.5}\n{"model": broken\n')
    rows = read_results(spark, str(tmp_path / "res")).collect()
    assert [r["model"] for r in rows if r["_corrupt_record"] is None] == ["a"]
    assert [r["_corrupt_record"] for r in rows if r["_corrupt_record"]] == ['{"model": broken']


def test_clients_csv_scan(spark, tmp_path):
    from credrisk.sources.io import read_clients_csv
    raw = spark.createDataFrame([tuple([1] * len(CLIENT_RAW.fields))], CLIENT_RAW)
    raw.write.option("header", True).csv(str(tmp_path / "c"))
    df = ingest(read_clients_csv(spark, str(tmp_path / "c")))
    assert "GENDER" in df.columns and "DEFAULT" in df.columns and df.count() == 1


def highest_likelihood(x, lo, hi):
    """λ of the largest Yeo-Johnson likelihood by golden-section search over plain arrays."""
    from credrisk.operators.prep import yeo_johnson_values
    log = np.sum(np.sign(x) * np.log1p(np.abs(x)))

    def llf(lam):
        return -len(x) / 2 * np.log(np.var(yeo_johnson_values(x, lam))) + (lam - 1) * log
    g = (5 ** 0.5 - 1) / 2
    for _ in range(80):
        left, right = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (left, hi) if llf(left) < llf(right) else (lo, right)
    return (lo + hi) / 2


def test_yeo_johnson_lambda_is_the_highest_likelihood(spark):
    from credrisk.operators.prep import yeo_johnson_lambdas
    rng = np.random.default_rng(2)
    skewed = np.log1p(np.maximum(0.05, 1 + 0.2 * rng.normal(size=800)) * 400) / 3          # left-skewed: a large lambda
    steep = 1 + 0.02 * rng.beta(9, 2, size=800)                                             # far beyond 60
    columns = {"a": skewed, "b": rng.lognormal(3, 1, 800), "c": rng.normal(size=800) * 5, "d": -rng.lognormal(3, 1, 800), "e": steep}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())] + [(None,) * 5], "a double, b double, c double, d double, e double")
    got = {r["variable"]: r["lambda"] for r in yeo_johnson_lambdas(df, list(columns)).collect()}
    for c, x in columns.items():
        assert got[c] == pytest.approx(highest_likelihood(x, -5, 400 if c == "e" else 40), abs=6e-4 if c == "e" else 6e-5), c
    assert got["e"] > 60 and got["b"] < 0.3


def test_yeo_johnson_lambda_without_an_answer(spark):
    from credrisk.operators.prep import YeoJohnsonTransformer, yeo_johnson_lambdas
    df = spark.createDataFrame([(5.0, None, 1.0, 1e6), (5.0, None, 1.0 + 1e-9, 1e6 + 1)], "same double, none double, near double, far double")
    got = {r["variable"]: r["lambda"] for r in yeo_johnson_lambdas(df, df.columns).collect()}
    assert set(got) == {"near", "far"} and all(np.isfinite(v) for v in got.values())  # a rising likelihood ends where doubles do
    model = YeoJohnsonTransformer(inputCols=["same"], outputCols=["out"]).fit(df)
    assert [r.out for r in model.transform(df).select("out").collect()] == [0.0, 0.0]


def test_registry_survives_a_killed_writer(spark, tmp_path):
    from pyspark.errors import PySparkException
    from credrisk.sources import io
    row = lambda name, path, status="loaded", error=None: (name, path, ["f"], 0.5, status, error)
    root = str(tmp_path)
    assert io.read_registry(spark, root).count() == 0
    io.publish_models(spark, root, [row("a", "p1"), row("b", "p2")])
    dying = io.read_registry(spark, root).withColumn("version", F.when(F.raise_error(F.lit("killed")).isNull(), 1))
    with pytest.raises(PySparkException):   # the writer dies while it writes the rows of a commit
        dying.write.json(f"{root}/manifest/9-dead")
    half = tmp_path / "manifest" / "8-dead"  # ... or between its tasks' commits and its own
    for place in (half / "_temporary" / "0" / "task_1", half):
        place.mkdir(parents=True, exist_ok=True)
        (place / "part-0.json").write_text('{"model": "a", "path": "half", "version": 99}\n{"model": "b", "pa')
    assert {(r.model, r.path) for r in io.read_registry(spark, root).collect()} == {("a", "p1"), ("b", "p2")}
    io.publish_models(spark, root, [row("a", "p3", "failed", "lost")])
    io.publish_models(spark, root, [row("b", "old")], version=1)
    assert {(r.model, r.path, r.error) for r in io.read_registry(spark, root).collect()} == {("a", "p3", "lost"), ("b", "p2", None)}
    assert [r.model for r in io.failed_models(io.read_registry(spark, root)).collect()] == ["a"]


def test_stream_scores_a_file_once_however_often_it_is_delivered(spark, tmp_path):
    from credrisk.operators.scoring import scorecard_score
    from credrisk.sources.clients import client_view
    from credrisk.streaming.scoring_stream import run_file_stream, scoring_frame
    raw = client_view(spark, "/root/testdata/sf0.001")
    source, sink, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    first, second = raw.where("ID % 2 = 0"), raw.where("ID % 2 = 1")
    first.write.mode("append").parquet(source)
    first.write.mode("append").parquet(source)                      # delivered twice at once
    run = lambda: run_file_stream(spark, source, scorecard_score, sink_dir=sink, checkpoint_dir=ckpt)
    assert run().count() == first.count()
    first.write.mode("append").parquet(source)                      # and again after the restart
    second.write.mode("append").parquet(source)
    got, want = run(), scoring_frame(raw, scorecard_score)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    changed = first.limit(1).withColumn("LIMIT_BAL", F.col("LIMIT_BAL") + 1)
    changed.write.mode("append").parquet(source)                    # a changed record is another row
    assert run().count() == want.count() + 1


def test_a_source_file_rewritten_under_its_name_is_read_again(spark, tmp_path):
    import shutil
    from credrisk.plans.catalog import clients
    for name in ("customer", "orders", "lineitem"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    before = clients(spark, str(tmp_path)).count()
    assert clients(spark, str(tmp_path)) is clients(spark, str(tmp_path))
    import pyarrow.parquet as pq
    table = pq.read_table(tmp_path / "customer.parquet")
    pq.write_table(table.slice(0, 40), tmp_path / "customer.parquet")
    spark.catalog.clearCache()
    assert before > 40 == clients(spark, str(tmp_path)).count()



def test_correlations_do_not_change_path_with_nulls(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]]) + 1000
    rows = [(float(a), float(b) if i % 7 else None, float(c) if i % 5 else None, 2.5) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    import pandas as pd
    want = pd.DataFrame(rows, columns=list("abck")).astype(float).corr()
    for r in corr_matrix(df, list("abck")).collect():
        w = want.loc[r["x"], r["y"]]
        assert (r["r"] is None and (np.isnan(w) or "k" in (r["x"], r["y"]))) or r["r"] == pytest.approx(w, abs=1e-6)
    assert {(r["x"], r["y"]): r["n"] for r in corr_matrix(df, list("abck")).collect()}[("b", "c")] == sum(1 for i in range(300) if i % 7 and i % 5)


def test_exact_quantiles_of_small_and_skewed_groups(spark):
    rng = np.random.default_rng(8)
    sets = {f"g{n}": rng.integers(0, 50, n).astype(float) for n in (1, 2, 3, 4, 5, 7, 11, 64, 333)}
    sets["big"] = np.concatenate([rng.lognormal(size=30_000), np.full(9_000, 1.0)])
    df = spark.createDataFrame([(g, float(v)) for g, xs in sets.items() for v in xs], "variable string, value double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["variable"], r["q"]): r["quantile"] for r in exact_quantiles(df, ["variable"], "value", qs).collect()}
    assert len(got) == len(sets) * len(qs)
    for (g, q), v in got.items():
        assert v == pytest.approx(np.quantile(sets[g], q)), (g, q)


def test_roc_curve_drops_points_inside_straight_steps(spark):
    rng = np.random.default_rng(3)
    rows = [(round(float(x), 2), int(y)) for x, y in zip(rng.random(400), rng.integers(0, 2, 400))] + [(2.0 + k, 1) for k in range(6)]
    df = spark.createDataFrame(rows, "score double, label int")
    got = [(r["fpr"], r["tpr"]) for r in ev.roc_curve(df, places=12).orderBy(F.desc_nulls_first("threshold")).collect()]
    scores = sorted({s for s, _ in rows}, reverse=True)
    pos = [sum(y for s, y in rows if s == x) for x in scores]
    neg = [sum(1 - y for s, y in rows if s == x) for x in scores]
    keep = [i for i in range(len(scores)) if i in (0, len(scores) - 1) or (pos[i], neg[i]) != (pos[i + 1], neg[i + 1])]
    want = [(0.0, 0.0)] + [(round(sum(neg[:i + 1]) / sum(neg), 12), round(sum(pos[:i + 1]) / sum(pos), 12)) for i in keep]
    assert got == want and len(keep) < len(scores)
    assert ev.pr_curve(df).count() == len(scores) + 1


def test_chi_square_equals_mllib(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest
    from credrisk.operators.association import chi_square
    rng = np.random.default_rng(11)
    rows = [(int(a), int(b), int((a + rng.integers(0, 3)) % 2)) for a, b in zip(rng.integers(1, 4, 300), rng.integers(0, 5, 300))]
    df = spark.createDataFrame(rows, "GENDER int, EDUCATION int, DEFAULT int")
    mine = {r["feature"]: (r["statistic"], r["dof"]) for r in chi_square(df, ["GENDER", "EDUCATION"]).collect()}
    vec = VectorAssembler(inputCols=["GENDER", "EDUCATION"], outputCol="f").transform(df)
    res = ChiSquareTest.test(vec, "f", "DEFAULT").first()
    assert mine["GENDER"][0] == pytest.approx(res.statistics[0], abs=1e-5) and mine["GENDER"][1] == res.degreesOfFreedom[0]
    assert mine["EDUCATION"][0] == pytest.approx(res.statistics[1], abs=1e-5)


def test_leaderboard_sink_and_source_round_trip(spark, tmp_path):
    from credrisk.sources.io import LEADERBOARD, read_leaderboard, write_leaderboard
    board = spark.createDataFrame([("m", 0.9, 0.8, 0.85, 0.5, 0.6, 0.4, "1. Baseline")], LEADERBOARD)
    write_leaderboard(board, str(tmp_path / "lb"))
    back = read_leaderboard(spark, str(tmp_path / "lb" / "csv")).first()
    assert back["model"] == "m" and back["auc"] == 0.85 and back["group"] == "1. Baseline"


def test_failed_artifacts_and_curve_filter(spark):
    from credrisk.sources.io import REGISTRY, RESULTS, failed_models, models_with_curves, registry_summary
    reg = spark.createDataFrame([("a", "/x", ["f"], 0.5, "loaded", None), ("b", "/y", ["f"], 0.3, "failed", "IOError")], REGISTRY)
    assert [r["model"] for r in failed_models(reg).collect()] == ["b"]
    s = registry_summary(reg).first()
    assert (s["loaded"], s["total"]) == (1, 2)
    docs = spark.createDataFrame([Row(model="a", auc=0.7, f1=0.1, fpr=[0.0], tpr=[0.0], prec=[1.0], rec=[0.0], cm=None,
                                      feature_importances=None, best_params=None),
                                  Row(model="b", auc=0.6, f1=0.1, fpr=[], tpr=[], prec=[], rec=[], cm=None,
                                      feature_importances=None, best_params=None)], RESULTS)
    assert [r["model"] for r in models_with_curves(docs).collect()] == ["a"]


def test_config_table_union(spark):
    from credrisk.operators.models import CONFIGS, config_table
    t = config_table(spark)
    assert t.count() == len(CONFIGS) == 13
    assert t.filter("rebalance = 'smote'").count() == 4


def test_corr_matrix_with_nulls_is_pairwise_complete(spark):
    import pandas as pd
    rng = np.random.default_rng(13)
    a = rng.normal(size=60)
    b = a * 0.5 + rng.normal(size=60)
    c = rng.normal(size=60)
    b[::7] = np.nan
    c[::5] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["x"], r["y"]): r["r"] for r in corr_matrix(df, ["a", "b", "c"]).collect()}
    want = pdf.corr()
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y], abs=1e-6)


@pytest.mark.parametrize("slices", [5, 40])
def test_thinned_curves_stay_near_the_exact_ones(spark, slices):
    rng = np.random.default_rng(slices)
    n = 4000
    label = (rng.random(n) < 0.3).astype(int)
    score = np.round(rng.normal(size=n) + label, 3)
    pred = spark.createDataFrame([(m, int(y), float(s)) for m, sign in (("good", 1), ("bad", -1)) for y, s in zip(label, sign * score)], "model string, label int, score double")
    roc = ev.roc_curve(pred, by=["model"]).withColumn("_o", F.coalesce(-F.col("threshold"), F.lit(-99.0))).withColumn("_u", (F.col("fpr") + F.col("tpr")) / 2)
    pr = ev.pr_curve(pred, by=["model"]).withColumn("_o", F.coalesce(F.col("threshold"), F.lit(99.0))).withColumn("_u", 1 - F.col("recall"))
    for curve, across in ((roc, "tpr"), (pr, "precision")):
        whole, kept = curve.toPandas(), ev.thinned(curve, "_o", "_u", across, slices, ["model"]).toPandas()
        assert set(kept.columns) == set(whole.columns)
        for model, exact in whole.groupby("model"):
            thin = kept[kept.model == model]
            assert len(thin) <= 4 * slices + 4 < len(exact) and thin.merge(exact, on=list(thin.columns)).shape[0] == len(thin)
            assert {exact._o.min(), exact._o.max()} <= set(thin._o)
            for _, p in exact.iterrows():
                near = thin[(thin._u - p._u).abs() <= 1 / slices]
                assert near[across].min() <= p[across] <= near[across].max()
    assert ev.thinned(roc.limit(0), "_o", "_u", "tpr", slices, ["model"]).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_wide_summary_equals_plain_quantiles(spark, most):
    from credrisk.operators.ordered import wide_summary
    rng = np.random.default_rng(1)
    n = 30_000
    frame = pd.DataFrame({"g": rng.integers(0, 2, n), "ties": rng.integers(0, 4, n).astype(float), "normal": rng.normal(size=n),
                          "mostly": np.where(rng.random(n) < 0.9, 0.0, rng.normal(size=n)), "some": np.where(rng.random(n) < 0.5, np.nan, rng.random(n))})
    rows = [tuple(None if x != x else x for x in r) for r in frame.itertuples(index=False)] + [(7, 1.0, None, 2.0, None), (8, None, None, None, None)]
    df = spark.createDataFrame([(int(r[0]), *r[1:]) for r in rows], "g int, ties double, normal double, mostly double, some double").repartition(5)
    cols, qs = ["ties", "normal", "mostly", "some"], {0.0: "q0", 0.25: "q1", 0.5: "q2", 0.9: "q3", 1.0: "q4"}
    plain = pd.DataFrame([(int(r[0]), *r[1:]) for r in rows], columns=["g", *cols]).astype({c: float for c in cols})
    for groups in ([], ["g"]):
        got = {(r["variable"], *(r[g] for g in groups)): r for r in wide_summary(df, cols, qs, groups, most=most).collect()}
        parts = [((), plain)] if not groups else [((k,), p) for k, p in plain.groupby("g")]
        assert len(got) == len(cols) * len(parts)
        for key, part in parts:
            for c in cols:
                x, r = part[c].dropna(), got[(c, *key)]
                assert r["count"] == len(x)
                if len(x):
                    assert [r[name] for name in qs.values()] == pytest.approx([x.quantile(q) for q in qs], abs=1e-12)
                    assert (r["min"], r["max"]) == (x.min(), x.max()) and r["mean"] == pytest.approx(x.mean())
                else:
                    assert all(r[name] is None for name in ("mean", "min", *qs.values()))
    assert wide_summary(df.limit(0), cols, qs, most=most).count() in (0, len(cols))
