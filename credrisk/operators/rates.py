"""Default rates by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import age_group, age_group_ord, edu_label, mar_label, rate_band, sex_label
from ..schema import TARGET

BREAKDOWNS = {
    "sex": ("SEX_LABEL", sex_label),
    "education": ("EDU_LABEL", edu_label),
    "marriage": ("MAR_LABEL", mar_label),
}


def default_rate_by(df: DataFrame, key: str) -> DataFrame:
    """Mean of DEFAULT × 100 and count of non-missing DEFAULT per level of
    ``key``; a missing level is dropped; sorted by key.  Partial aggregation
    runs map-side, so a level holding most rows is not a hot spot."""
    return (df.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.round(F.avg(F.col(TARGET).cast("double")) * 100, 4).alias("default_rate_pct"),
                 F.count(TARGET).alias("count"))
            .orderBy(key))


def default_rate_breakdown(df: DataFrame, which: str) -> DataFrame:
    name, fn = BREAKDOWNS[which]
    return default_rate_by(df.withColumn(name, fn()), name)


def default_rate_by_age(df: DataFrame) -> DataFrame:
    """Observed age groups in bin order, rate to 1 dp and its severity band."""
    g = (df.withColumns({"AGE_GROUP": age_group(), "age_group_ord": age_group_ord()})
         .filter(F.col("AGE_GROUP").isNotNull())
         .groupBy("AGE_GROUP", "age_group_ord")
         .agg(F.avg(F.col(TARGET).cast("double")).alias("_m"), F.count(TARGET).alias("count")))
    rate = F.round(F.col("_m") * 100, 1)
    return (g.select("AGE_GROUP", "age_group_ord", rate.alias("default_rate_pct"), "count",
                     rate_band(rate).alias("band"))
            .orderBy("age_group_ord"))


def default_rate_breakdowns(df: DataFrame) -> DataFrame:
    """All breakdowns in one aggregation: GROUPING SETS over sex, education,
    marriage, age group and the total.  Output: breakdown, level, rate, count."""
    keys = ["SEX_LABEL", "EDU_LABEL", "MAR_LABEL", "AGE_GROUP"]
    labelled = df.withColumns({"SEX_LABEL": sex_label(), "EDU_LABEL": edu_label(),
                               "MAR_LABEL": mar_label(), "AGE_GROUP": age_group()})
    g = labelled.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id().alias("_gid"),
        F.avg(F.col(TARGET).cast("double")).alias("_m"),
        F.count(TARGET).alias("count"))
    n = len(keys)
    breakdown = F.lit("total")
    level = F.lit(None).cast("string")
    names = ["sex", "education", "marriage", "age_group"]
    for i, (k, nm) in enumerate(zip(keys, names)):
        gid = (2 ** n - 1) ^ (1 << (n - 1 - i))
        breakdown = F.when(F.col("_gid") == gid, F.lit(nm)).otherwise(breakdown)
        level = F.when(F.col("_gid") == gid, F.col(k)).otherwise(level)
    out = g.select(breakdown.alias("breakdown"), level.alias("level"),
                   F.round(F.col("_m") * 100, 4).alias("default_rate_pct"), "count")
    # pandas drops a missing level; the total row has no level by design
    return out.filter(F.col("level").isNotNull() | (F.col("breakdown") == "total"))


def class_balance(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Class counts, imbalance ratio n0/n1 (the positive-class weight) and rate."""
    y = F.col(label)
    return df.agg(
        F.count_if(y == 0).alias("n_neg"),
        F.count_if(y == 1).alias("n_pos"),
        (F.count_if(y == 0).cast("double") / F.nullif(F.count_if(y == 1), F.lit(0))).alias("scale_pos_weight"),
        F.round(F.avg(y.cast("double")) * 100, 4).alias("default_rate_pct"),
    )
