"""The ``clients`` view: one client record per customer, built from the
customer / orders / lineitem tables (rules in FIXTURES.md §3).

The view only supplies rows in the client schema; every analysis downstream
works on any DataFrame of that schema.

Plan shape (three shuffles, each pre-aggregated map-side):
  lineitem --partial agg--> [l_orderkey]  --join--  orders [o_orderkey]
       --partial agg--> [o_custkey]  --join--  customer [c_custkey]
Each order contributes to one of seven periods; the per-customer wide row is a
single conditional aggregation, so a hot customer is combined map-side before
the shuffle and never gathered as raw rows in one task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BILL_COLS, PAY_AMT_COLS, PAY_COLS, RAW_TARGET
from .tables import table

# Fixed values of the fixture: the outcome year and the observed window.
OUTCOME_YEAR = 2001
N_PERIODS = 6


def _order_amounts(lineitem: DataFrame) -> DataFrame:
    """Per order: paid amount over non-returned lines, number of returned lines."""
    returned = F.col("l_returnflag") == "R"
    paid = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long")
    return lineitem.groupBy("l_orderkey").agg(
        F.sum(F.when(~returned, paid).otherwise(F.lit(0).cast("long"))).alias("pay"),
        F.sum(F.when(returned, 1).otherwise(0)).cast("long").alias("late"),
    )


def client_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw client records (``SEX`` and ``default.payment.next.month`` names)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_extendedprice", "l_discount", "l_returnflag")

    per_order = (
        orders.filter((F.col("o_orderdate") >= F.lit(date(OUTCOME_YEAR - N_PERIODS, 1, 1)))   # a range that the scan can use
                      & (F.col("o_orderdate") < F.lit(date(OUTCOME_YEAR + 1, 1, 1))))
        .withColumn("p", F.lit(OUTCOME_YEAR) - F.year("o_orderdate"))
        .join(_order_amounts(lineitem), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            "o_custkey", "p",
            F.round("o_totalprice").cast("long").alias("bill"),
            F.coalesce("pay", F.lit(0).cast("long")).alias("pay"),
            F.coalesce("late", F.lit(0).cast("long")).alias("late"),
        )
    )

    aggs = []
    for p in range(0, N_PERIODS + 1):
        at = F.col("p") == p
        aggs += [
            F.sum(F.when(at, 1).otherwise(0)).cast("long").alias(f"n{p}"),
            F.sum(F.when(at, F.col("bill")).otherwise(0)).cast("long").alias(f"b{p}"),
            F.sum(F.when(at, F.col("pay")).otherwise(0)).cast("long").alias(f"a{p}"),
            F.sum(F.when(at, F.col("late")).otherwise(0)).cast("long").alias(f"r{p}"),
        ]
    per_customer = per_order.groupBy("o_custkey").agg(*aggs)

    joined = customer.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")

    def z(name: str):
        return F.coalesce(F.col(name), F.lit(0).cast("long"))

    def status(p: int):
        return (F.when(z(f"n{p}") == 0, F.lit(-2))
                .when(z(f"a{p}") >= z(f"b{p}"), F.lit(-1))
                .otherwise(F.least(F.lit(8), z(f"r{p}").cast("int")))).cast("int")

    carried = (F.when((z("n1") == 0) | (z("a1") >= z("b1")), F.lit(0))
               .otherwise(F.least(F.lit(8), z("r1").cast("int"))))
    key = F.col("c_custkey")
    cols = [
        key.alias("ID"),
        F.when(F.col("c_acctbal") < 0, F.lit(0).cast("long"))
         .otherwise((10000 * (1 + F.floor(F.col("c_acctbal") / 100))).cast("long")).alias("LIMIT_BAL"),
        F.when(key % 50 == 0, F.lit(0)).otherwise(1 + key % 2).cast("int").alias("SEX"),
        (key % 7).cast("int").alias("EDUCATION"),
        (F.col("c_nationkey") % 4).cast("int").alias("MARRIAGE"),
        (20 + (key * 7) % 62).cast("int").alias("AGE"),
    ]
    cols += [status(p).alias(c) for p, c in zip(range(1, 7), PAY_COLS)]
    cols += [z(f"b{p}").alias(c) for p, c in zip(range(1, 7), BILL_COLS)]
    cols += [z(f"a{p}").alias(c) for p, c in zip(range(1, 7), PAY_AMT_COLS)]
    cols += [F.when(z("r0") + carried >= 5, 1).otherwise(0).cast("int").alias(RAW_TARGET)]
    return joined.select(*cols)


# DuckDB rendering of the same view, used as the common table expression of
# every oracle query.  Already ingested (GENDER / DEFAULT names).
CLIENTS_CTE = """
clients_order_amounts AS (
  SELECT l_orderkey,
         CAST(SUM(CASE WHEN l_returnflag <> 'R'
                  THEN CAST(floor(l_extendedprice * (1 - l_discount)) AS BIGINT) ELSE 0 END) AS BIGINT) AS pay,
         CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS late
  FROM lineitem GROUP BY l_orderkey
),
clients_per_order AS (
  SELECT o.o_custkey, 2001 - year(o.o_orderdate) AS p,
         CAST(round(o.o_totalprice) AS BIGINT) AS bill,
         COALESCE(a.pay, 0) AS pay, COALESCE(a.late, 0) AS late
  FROM orders o LEFT JOIN clients_order_amounts a ON o.o_orderkey = a.l_orderkey
  WHERE 2001 - year(o.o_orderdate) BETWEEN 0 AND 6
),
clients_per_period AS (
  SELECT o_custkey, p, COUNT(*) AS n, CAST(SUM(bill) AS BIGINT) AS b,
         CAST(SUM(pay) AS BIGINT) AS a, CAST(SUM(late) AS BIGINT) AS r
  FROM clients_per_order GROUP BY o_custkey, p
),
clients_wide AS (
  SELECT c.c_custkey, c.c_nationkey, c.c_acctbal,
  {wide}
  FROM customer c LEFT JOIN clients_per_period q ON q.o_custkey = c.c_custkey
  GROUP BY c.c_custkey, c.c_nationkey, c.c_acctbal
),
clients AS (
  SELECT CAST(c_custkey AS BIGINT) AS ID,
    CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE 10000 * (1 + floor(c_acctbal / 100)) END AS BIGINT) AS LIMIT_BAL,
    CAST(CASE WHEN c_custkey % 50 = 0 THEN 0 ELSE 1 + c_custkey % 2 END AS INTEGER) AS GENDER,
    CAST(c_custkey % 7 AS INTEGER) AS EDUCATION,
    CAST(c_nationkey % 4 AS INTEGER) AS MARRIAGE,
    CAST(20 + (c_custkey * 7) % 62 AS INTEGER) AS AGE,
  {status},
  {amounts},
    CAST(CASE WHEN r0 + (CASE WHEN n1 = 0 OR a1 >= b1 THEN 0 ELSE least(8, r1) END) >= 5
         THEN 1 ELSE 0 END AS INTEGER) AS "DEFAULT"
  FROM clients_wide
)"""


def _render_cte() -> str:
    wide = ",\n  ".join(
        f"CAST(COALESCE(SUM(CASE WHEN q.p = {p} THEN q.{v} END), 0) AS BIGINT) AS {v}{p}"
        for p in range(0, 7) for v in ("n", "b", "a", "r"))
    status = ",\n  ".join(
        f"CAST(CASE WHEN n{p} = 0 THEN -2 WHEN a{p} >= b{p} THEN -1 ELSE least(8, r{p}) END AS INTEGER) AS {c}"
        for p, c in zip(range(1, 7), PAY_COLS))
    amounts = ",\n  ".join(
        [f"b{p} AS {c}" for p, c in zip(range(1, 7), BILL_COLS)]
        + [f"a{p} AS {c}" for p, c in zip(range(1, 7), PAY_AMT_COLS)])
    return CLIENTS_CTE.format(wide=wide, status=status, amounts=amounts)


CLIENTS_SQL = _render_cte()


def with_clients(sql: str, *ctes: str) -> str:
    """Prefix an oracle query with the ``clients`` CTE (plus extra CTEs)."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {CLIENTS_SQL}{extra}\n{sql}"
