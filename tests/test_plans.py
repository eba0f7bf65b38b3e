"""Physical-plan properties that matter at scale (checked on the small tables)."""
import re

import pytest

from credrisk.operators import evaluation as ev
from credrisk.operators.sampling import stratified_split
from credrisk.plans.catalog import QUERIES, load_all
from credrisk.sources.clients import client_view

from conftest import SMOKE

load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_client_view_prunes_and_pushes_down(spark):
    p = plan(client_view(spark, SMOKE))
    li = re.search(r"lineitem\.parquet.*?ReadSchema: (struct<[^>]*>)", p, re.S) or re.search(r"ReadSchema: (struct<l_[^>]*>)", p)
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    line = [s for s in schemas if "l_orderkey" in s][0]
    assert set(re.findall(r"(\w+):", line)) == {"l_orderkey", "l_extendedprice", "l_discount", "l_returnflag"}
    assert "GreaterThanOrEqual(o_orderdate,1995-01-01" in p and "LessThan(o_orderdate,2" in p   # the plan's text is cut there
    assert "o_orderdate#" in p and re.search(r"DataFilters: \[[^\]]*o_orderdate#\d+ < 2002-01-01", p)
    assert li is not None


def test_analyses_read_only_their_columns_of_the_client_table(spark):
    from credrisk.plans.catalog import clients
    p = plan(QUERIES["default_rate_by_education"](spark, SMOKE))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert schemas and all(set(re.findall(r"(\w+):", s)) <= {"EDUCATION", "DEFAULT"} for s in schemas), schemas
    assert clients(spark, SMOKE) is clients(spark, SMOKE)


def test_no_cartesian_or_nested_loop_joins(spark):
    for name in ("corr_matrix", "histogram_by_class", "box_by_class", "profile_numeric", "default_rate_breakdowns"):
        p = plan(QUERIES[name](spark, SMOKE))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_ordered_plans_avoid_single_partition(spark):
    s = spark.createDataFrame([(i / 100.0, i % 3 == 0) for i in range(100)], "score double, y boolean")
    s = s.selectExpr("score", "cast(y as int) as label")
    ids = spark.range(1, 200).selectExpr("id as ID", "cast(id % 4 = 0 as int) as DEFAULT")
    for df in (ev.roc_auc(s), ev.roc_curve(s), ev.pr_curve(s), stratified_split(ids)):
        p = plan(df)
        # the row-level running window is partitioned by range bucket ...
        assert re.search(r"Window \[.*\], \[(\w+#\d+, )?_bucket#\d+\]", p), p
        # ... only bounded tables are gathered: the bucket totals, the first rows of
        # the buckets (ROC) and the final merge of a one-row global aggregate
        assert p.count("SinglePartition") <= 3
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


@pytest.fixture
def every_plan(monkeypatch):
    """Plans of all actions, also of those that builders run before they return."""
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.readwriter import DataFrameWriter
    seen = []

    def watched(cls, name, frame):
        run = getattr(cls, name)

        def wrapper(self, *args, **kwargs):
            seen.append(plan(frame(self)))
            return run(self, *args, **kwargs)
        monkeypatch.setattr(cls, name, wrapper)
    for name in ("collect", "count", "first", "toPandas", "isEmpty"):
        watched(DataFrame, name, lambda df: df)
    for name in ("parquet", "json", "csv", "save"):
        watched(DataFrameWriter, name, lambda writer: writer._df)
    return seen


def test_no_registered_query_plans_a_nested_loop_join(spark, every_plan):
    """Joins are hash joins (broadcast only for bounded tables); bounded
    scalars and bucket tables are inlined as literals instead of joined.  Jobs inside the
    builders count as well."""
    bad = []
    for name in sorted(QUERIES):
        if name.startswith(("model_", "train_", "results_", "result_curves", "top_importances_", "failed_")) and name not in (
                "model_logistic", "model_tuned_weight", "model_lookup"):
            continue  # thirteen fits: the plans of one and of a search stand for them
        every_plan.clear()
        plans = [plan(QUERIES[name](spark, SMOKE)), *every_plan]
        bad += [(name, p) for p in plans if "BroadcastNestedLoopJoin" in p or "CartesianProduct" in p]
    assert not bad, bad[0]


def test_curves_of_fitted_models_are_whole(spark, tmp_path):
    """They were thinned to 516 points at most."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from credrisk.plans import model_queries as mq
    rng, cards, want = np.random.default_rng(4), [], {}
    for model, digits in (("a", 9), ("b", 9), ("c", 1)):
        score, split = rng.random(3000).round(digits), np.where(rng.random(3000) < 0.2, "train", "test")
        frame = pd.DataFrame({"model": model, "group": "g", "threshold": 0.5, "ID": range(3000), "split": split,
                              "label": (rng.random(3000) < score).astype(int), "score": score})
        card = {"model": model, "best_params": None, **{k: str(tmp_path / f"{model}-{k}") for k in ("predictions", "importances")}}
        spark.createDataFrame(frame).withColumn("label", F.col("label").cast("int")).repartition(3).write.parquet(card["predictions"])
        spark.createDataFrame([("x", 1.0)], "feature string, importance double").write.parquet(card["importances"])
        cards.append(card)
        n = frame[frame.split == "test"].groupby("score").label.agg(["sum", "size"])
        down = n[::-1].cumsum()
        neg = down["size"] - down["sum"]
        steps = list(zip(n["sum"][::-1], (n["size"] - n["sum"])[::-1]))
        bends = [k for k in range(len(steps)) if k in (0, len(steps) - 1) or steps[k + 1] != steps[k]]
        want[model, "roc"] = [(0.0, 0.0)] + [(neg.iloc[k] / neg.iloc[-1], down["sum"].iloc[k] / down["sum"].iloc[-1]) for k in bends]
        want[model, "pr"] = [*zip((down["sum"] / down["sum"].iloc[-1])[::-1], (down["sum"] / down["size"])[::-1]), (0.0, 1.0)]
    got = mq._curve_rows(spark, cards).toPandas().sort_values(["model", "curve", "point"])
    assert list(got.columns) == ["model", "curve", "point", "x", "y"] and len(want["a", "pr"]) > 2000 and len(want["a", "roc"]) > 516
    doc = {r.model: r for r in mq.results_of(spark, cards).collect()}
    for (model, curve), points in want.items():
        part = got[(got.model == model) & (got.curve == curve)]
        assert part.point.tolist() == list(range(len(points)))
        assert np.allclose(part[["x", "y"]], points, atol=1e-6)
        r = doc[model]
        assert [*zip(part.x, part.y)] == ([*zip(r.fpr, r.tpr)] if curve == "roc" else [*zip(r.rec, r.prec)])
