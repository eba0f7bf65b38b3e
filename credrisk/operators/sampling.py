"""Stratified split and folds, class weights.

Rows are ordered inside each class by ``md5('<seed>:' || ID)``, a seeded
random order that SQL engines reproduce.  The rank inside the class comes
from :func:`running_sums` with the first hex digits of the hash as the range bucket
(ordered, uniformly filled by construction; at least 4,096 per class and sixteen per shuffle
partition), so the class-wide rank never needs a two-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import N_FOLDS, SEED, TARGET, TEST_FRACTION
from .ordered import running_sums


def seeded_hash(key: str = "ID", seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_bucket(df: DataFrame, hashed: str = "_h") -> Column:
    """The first hex digits of a hash as a number: enough for sixteen buckets per shuffle partition."""
    partitions, digits = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3
    while 16 ** digits < 16 * partitions:
        digits += 1
    return F.conv(F.substring(hashed, 1, digits), 16, 10).cast("int")


def class_rank(df: DataFrame, label: str = TARGET, key: str = "ID", seed: int = SEED) -> DataFrame:
    """Add ``_h`` (seeded hash) and ``class_rank`` (1-based, in hash order, per class)."""
    h = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_sums(h, [("_h", True), (key, True)], ["_one"], groups=[label], bucket=hash_bucket(h))
    return ranked.withColumnRenamed("cum__one", "class_rank").drop("before__one", "_one")


def stratified_split(df: DataFrame, test_fraction: float = TEST_FRACTION, label: str = TARGET,
                     key: str = "ID", seed: int = SEED, n_folds: int = N_FOLDS) -> DataFrame:
    """Exact stratified split: in each class the ``round(f·n_class)`` first rows
    in seeded order are test rows.  Training rows also get a stratified fold
    ``(rank − n_test − 1) mod n_folds``; test rows get NULL.

    Adds ``split`` ('train' / 'test') and ``fold``.
    """
    df = df.withColumn(label, F.coalesce(label, F.raise_error(F.lit(f"{label} is NULL: cannot stratify")).cast(df.schema[label].dataType)))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_class"))
    sizes = sizes.withColumn("_n_test", F.round(F.col("_n_class") * test_fraction).cast("long"))
    ranked = class_rank(df, label, key, seed)
    # one row per class: a bounded broadcast
    out = ranked.join(F.broadcast(sizes), label, "left")
    is_test = F.col("class_rank") <= F.col("_n_test")
    fold = F.when(~is_test, F.pmod(F.col("class_rank") - F.col("_n_test") - 1, F.lit(n_folds)))
    return (out.withColumn("split", F.when(is_test, "test").otherwise("train"))
            .withColumn("fold", fold.cast("int"))
            .drop("_h", "_n_class", "_n_test"))


def train_part(split_df: DataFrame) -> DataFrame:
    return split_df.filter(F.col("split") == "train")


def test_part(split_df: DataFrame) -> DataFrame:
    return split_df.filter(F.col("split") == "test")


def balanced_weights(train: DataFrame, label: str = TARGET) -> DataFrame:
    """Per class: n / (2 · n_class) — the 'balanced' class weight."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    # the class table has one row per class: a window over it is tiny
    n = F.sum("n_class").over(Window.partitionBy())
    return counts.select(label, "n_class", n.alias("n"),
                         (n / (2.0 * F.col("n_class"))).alias("weight"))
