"""Messy orders derived from the ``orders`` table, and their companions.

Each recipe is one SQL text that means the same in Spark and in DuckDB, so that a query and the SQL it is
checked against start from the same rows. ``mode`` (key modulo 40) names the fault of a row; modes from 22
are clean. Files of the tables are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendery.contract import ORDERS
from mendery.session import settle_table
from mendery.sources.rows import normalise_columns, row_frame

MESSY_SQL = """
SELECT k AS row_index, cast(floor(k / 500) AS bigint) + 1 AS run_id, m AS mode,
  CASE WHEN m IN (4, 10, 16) THEN concat(oid, moji)
       WHEN m = 8 THEN oid_next
       WHEN m = 15 OR (m = 6 AND bf = 0) THEN ''
       WHEN m = 19 THEN '1,234'
       WHEN m = 20 THEN concat('  ', oid, chr(9))
       ELSE oid END AS order_id,
  CASE WHEN m IN (5, 10) THEN concat(cid, moji)
       WHEN m IN (7, 16) THEN concat('CUST-X', lpad(cast(k AS string), 12, '0'))
       WHEN m = 6 AND bf = 1 THEN ''
       ELSE cid END AS customer_id,
  CASE WHEN m IN (3, 10) THEN concat(substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4))
       WHEN m = 18 THEN concat(d, 'T14:30:00')
       WHEN m = 21 THEN concat(substr(d, 6, 2), '/', substr(d, 9, 2), '/', substr(d, 3, 2))
       WHEN m = 6 AND bf = 2 THEN ''
       ELSE d END AS order_date,
  CASE WHEN m IN (0, 10, 15) THEN concat('$', amt)
       WHEN m = 1 THEN 'fifty-two' WHEN m = 2 THEN 'N/A'
       WHEN m = 13 THEN '49.123' WHEN m = 14 THEN '(49.99)'
       WHEN m = 17 THEN '€1,234.56' WHEN m = 19 THEN '$5.00'
       WHEN m = 20 THEN concat(' ', amt, ' ')
       WHEN m = 6 AND bf = 3 THEN ''
       ELSE amt END AS amount,
  CASE WHEN m = 11 THEN 'ZZZ' WHEN m = 6 AND bf = 4 THEN '' ELSE cur END AS currency,
  CASE WHEN m = 12 THEN 'unknown' WHEN m = 6 AND bf = 5 THEN '' ELSE st END AS status
FROM (
  SELECT o_orderkey AS k, o_orderkey % 40 AS m,
    concat('ORD-', lpad(cast(o_orderkey AS string), 12, '0')) AS oid,
    concat('ORD-', lpad(cast(o_orderkey + 1 AS string), 12, '0')) AS oid_next,
    concat('CUST-', lpad(cast(o_custkey AS string), 12, '0')) AS cid,
    cast(cast(o_orderdate AS date) AS string) AS d,
    cast(cast(o_totalprice AS decimal(12,2)) AS string) AS amt,
    cast(floor(o_orderkey / 40) AS bigint) % 6 AS bf,
    CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'CAD' WHEN 4 THEN 'AUD' ELSE 'JPY' END AS cur,
    CASE o_orderkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'shipped' WHEN 3 THEN 'delivered' WHEN 4 THEN 'cancelled' ELSE 'refunded' END AS st,
    concat('Ã¡Ã©Ã', chr(173), 'Ã³Ãº') AS moji
  FROM {orders}) b
"""

KNOWN_SQL = """
SELECT concat('CUST-', lpad(cast(c_custkey AS string), 12, '0')) AS customer_id
FROM {customer} WHERE c_custkey % 97 <> 0
"""

EXISTING_SQL = """
SELECT concat('ORD-', lpad(cast(o_orderkey AS string), 12, '0')) AS order_id
FROM {orders} WHERE o_orderkey % 53 = 0
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WRITTEN: dict[tuple[str, str], DataFrame] = {}


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Messy orders as they arrive: untrimmed text, with run_id, row_index and mode.

    Written once per session and folder, as arriving data would be: otherwise the long expressions of the
    recipe are substituted into every rule that looks at a value.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _WRITTEN:
        _WRITTEN[key] = settle_table(spark.sql(MESSY_SQL, orders=table(spark, folder, "orders")), "messy-orders")
    return _WRITTEN[key]


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Row frame of the messy orders."""
    trimmed = normalise_columns(raw_orders(spark, folder), keep=("run_id", "row_index", "mode"))
    return row_frame(trimmed, ORDERS, F.col("run_id"), F.col("row_index"))


def known_customers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(KNOWN_SQL, customer=table(spark, folder, "customer"))


def existing_orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(EXISTING_SQL, orders=table(spark, folder, "orders"))


def run_clock(run_id: Column) -> Column:
    """Made-up but fixed start of a run: one minute after the other."""
    return F.timestamp_seconds(F.lit(1_767_225_600) + run_id * 60)


def with_run_state(counts: DataFrame) -> DataFrame:
    """Run rows from run counts: a start time, and some runs that did not complete."""
    run = F.col("run_id")
    return counts.withColumns(
        {
            "started_at": run_clock(run),
            "status": F.when(run % 11 == 0, F.lit("failed"))
            .when(run % 13 == 0, F.lit("rejected_schema_drift"))
            .when(run % 17 == 0, F.lit("running"))
            .otherwise(F.lit("completed")),
        }
    )
