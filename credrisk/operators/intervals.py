"""Range lookup in a table of bands (J3): (lo, hi] → label, per key.

Bands come as rows, thousands a key if need be, so they can't be a chain of conditions, and a
join on ``x > lo AND x <= hi`` alone would be a nested loop.  Two plans:

* *interval index*: the bands of a key become one array sorted by lower bound; a value finds its
  band by binary search in that array, one expression per row and no shuffle of the rows.  Used
  while the whole table holds at most ``max_index_bands`` bands, counted first, as it is broadcast.
* *range buckets*: split points from a sketch of the lower bounds cut each key's axis; a band goes
  to every bucket that it touches, a value to its one bucket, and the join is an equi-join on
  (key, bucket) with the bounds as a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_INDEX_BANDS = 500_000
BUCKETS = 256


def search(bands: Column, value: Column, steps: Column) -> Column:
    """Position (from 1) of the last band whose lower bound is below ``value``, 0 if there is none.

    A fold halves [lo, hi) ``steps`` times; the array is passed on, never copied.
    """
    start = F.struct(F.lit(0).alias("lo"), (F.size(bands) + 1).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (middle > s["lo"]) & (F.get(bands, middle - 1)["lo"] < value)
        return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(
            F.struct(F.when(below, middle).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(middle).alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), steps), start, halve)["lo"]


def band_lookup(df: DataFrame, value: str, bands: DataFrame, keys: list[str] | None = None,
                max_index_bands: int = MAX_INDEX_BANDS) -> DataFrame:
    """``df`` with the ``label`` of the band (lo, hi] that holds ``value`` among those of its ``keys``.

    ``bands`` has the key columns, ``lo``, ``hi`` (NULL: unbounded) and ``label``; the bands of a key must not
    overlap.  A value on a bound belongs to the band that ends there; a NULL value, a NULL
    key and a value between bands have no label; bands with lo >= hi hold nothing.
    """
    keys = list(keys or [])
    inf = float("inf")
    table = bands.select(*keys, F.coalesce(F.col("lo").cast("double"), F.lit(-inf)).alias("lo"),
                         F.coalesce(F.col("hi").cast("double"), F.lit(inf)).alias("hi"), "label").where("lo < hi")
    if table.count() <= max_index_bands:
        return _by_index(df, value, table, keys)
    return _by_bucket(df, value, table, keys)


def _by_index(df: DataFrame, value: str, table: DataFrame, keys: list[str]) -> DataFrame:
    entry = F.struct("lo", "hi", "label")
    index = table.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_bands"))
    x = F.col(value).cast("double")
    if keys:
        out = df.join(F.broadcast(index), keys, "left")
    else:  # a single row, which a constant key carries (inlined, it would grow the plan by all bands)
        out = df.withColumn("_one", F.lit(1)).join(F.broadcast(index.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    bands = F.col("_bands")
    steps = F.ceil(F.log2(F.size(bands) + 1)).cast("int") + 1
    at = F.when(bands.isNotNull() & x.isNotNull(), search(bands, x, steps))
    found = out.withColumn("_at", at).withColumn("_hit", F.when(F.col("_at") > 0, F.get(bands, F.col("_at") - 1)))
    return found.withColumn("label", F.when(x <= F.col("_hit.hi"), F.col("_hit.label"))).drop("_bands", "_at", "_hit")


def _by_bucket(df: DataFrame, value: str, table: DataFrame, keys: list[str]) -> DataFrame:
    marks = [i / BUCKETS for i in range(1, BUCKETS)]
    row = table.where(F.abs("lo") < float("inf")).agg(F.percentile_approx("lo", marks, 10_000).alias("m")).first()
    splits = F.array(*[F.lit(float(m)) for m in sorted(set(row["m"] or []))]).cast("array<double>")  # BUCKETS numbers at most

    def bucket(x: Column) -> Column:
        return F.aggregate(splits, F.lit(0), lambda n, s: n + F.when(s < x, 1).otherwise(0))

    x = F.col(value).cast("double")
    spread = table.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    rows = df.withColumn("_x", x).withColumn("_bucket", bucket(x))
    b = spread.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), "lo", "hi", "label")
    same = [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_bucket") == F.col("_b"), F.col("_x") > F.col("lo"), F.col("_x") <= F.col("hi")]
    return rows.join(b, same, "left").select(*df.columns, "label")
