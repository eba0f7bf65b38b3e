"""Range lookup in a table of bands: index and bucket plans against plain search."""
import bisect
import random

import pytest

from credrisk.operators import intervals as iv


def bands_of(spark, n=10_000):
    rng = random.Random(1)
    cuts = sorted(rng.uniform(-1000, 1000) for _ in range(n + 1))
    rows = [("big", lo, hi, f"b{k}") for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if k % 7]          # gaps
    rows += [("small", None, 0.0, "neg"), ("small", 0.0, None, "pos"), ("one", 1.0, 2.0, "x"), ("empty", 3.0, 3.0, "none"), (None, 0.0, 9.0, "null key")]
    return spark.createDataFrame(rows, "k string, lo double, hi double, label string"), cuts


def expected(k, x, cuts):
    if x is None or k is None:
        return None
    if k == "big":
        i = bisect.bisect_left(cuts, x) - 1
        return f"b{i}" if 0 <= i < len(cuts) - 1 and i % 7 else None
    return {"small": lambda: "neg" if x <= 0 else "pos", "one": lambda: "x" if 1 < x <= 2 else None}.get(k, lambda: None)()


@pytest.mark.parametrize("limit", [iv.MAX_INDEX_BANDS, 0])
def test_lookup_in_ten_thousand_bands(spark, limit):
    bands, cuts = bands_of(spark)
    rng = random.Random(2)
    rows = [(i, "big", rng.choice([rng.uniform(-1010, 1010), rng.choice(cuts)])) for i in range(3000)]
    rows += [(5000 + i, k, x) for i, (k, x) in enumerate((k, x) for k in ("small", "one", "empty", "absent", None) for x in (None, -1.0, 0.0, 1.0, 1.5, 2.0, 3.0, float("inf")))]
    frame = spark.createDataFrame(rows, "id long, k string, x double")
    out = iv.band_lookup(frame, "x", bands, ["k"], max_index_bands=limit)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.columns == ["id", "k", "x", "label"] or set(out.columns) == {"id", "k", "x", "label"}
    got = {r.id: r.label for r in out.collect()}
    assert len(got) == len(rows) and got == {i: expected(k, x, cuts) for i, k, x in rows}


@pytest.mark.parametrize("limit", [iv.MAX_INDEX_BANDS, 0])
def test_lookup_without_keys_and_without_bands(spark, limit):
    bands = spark.createDataFrame([(0, 10, 1), (10, 20, 2), (30, None, 3)], "lo int, hi int, label int")
    frame = spark.createDataFrame([(x,) for x in (None, -1, 0, 1, 10, 11, 20, 25, 30, 31, 10**9)], "x int")
    out = {r.x: r.label for r in iv.band_lookup(frame, "x", bands, max_index_bands=limit).collect()}
    assert out == {None: None, -1: None, 0: None, 1: 1, 10: 1, 11: 2, 20: 2, 25: None, 30: None, 31: 3, 10**9: 3}
    assert {r.label for r in iv.band_lookup(frame, "x", bands.limit(0), max_index_bands=limit if limit else -1).collect()} == {None}
