"""``dirty_sales``: a sales table with planted defects, derived by Spark from
the given tables (lineitem ⋈ orders ⋈ customer ⋈ part), one row per line item.

The SQL text is shared verbatim with the DuckDB twins (it gives identical rows
in both engines).  Tables are passed as DataFrame parameters, so no temp view
is registered in the caller's session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillpoint.session import spread
from tillpoint.sources.tables import load

_DEFECTS_SQL = """
SELECT l_orderkey,
  CASE WHEN l_orderkey % 97 = 0 THEN 'AVIN' ELSE CAST(l_orderkey AS STRING) END AS idx,
  concat(
    lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-',
    lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-',
    CASE WHEN l_orderkey % 73 = 0 THEN '26' WHEN l_orderkey % 79 = 0 THEN '31'
         ELSE substr(CAST(year(o_orderdate) AS STRING), 3, 2) END) AS order_date_txt,
  CASE WHEN l_orderkey % 83 = 0 THEN 'Heads'
       WHEN o_custkey % 50 = 0 THEN 'Apr-22'
       WHEN o_custkey % 50 = 1 THEN 'none'
       ELSE concat('  ', lower(c_name), '  ') END AS customer_txt,
  p_type AS size_txt,
  CASE WHEN l_orderkey % 41 = 0 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING))
       ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS qty_txt,
  CASE WHEN l_orderkey % 43 = 0 THEN 'N/A'
       WHEN l_orderkey % 71 = 0 THEN concat('-', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING))
       ELSE concat('₹', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), '.00') END AS rate_txt,
  CASE WHEN l_orderkey % 47 = 0 THEN 'Rs 0.15/- Per Day'
       WHEN l_orderkey % 53 = 0 THEN '9,999,999.00'
       WHEN l_orderkey % 59 = 0 THEN concat(CAST(CAST(l_quantity AS BIGINT) * CAST(floor(p_retailprice) AS BIGINT) + 500 AS STRING), '.00')
       ELSE concat('₹ ', CAST(CAST(l_quantity AS BIGINT) * CAST(floor(p_retailprice) AS BIGINT) AS STRING), '.00') END AS amount_txt,
  CASE WHEN l_orderkey % 83 = 0 THEN 'Price (Per Unit)'
       WHEN l_orderkey % 61 = 0 THEN '<b>drop</b> table -- x'
       WHEN l_orderkey % 67 = 0 THEN '  two   spaces ' ELSE 'plain' END AS note_txt,
  CAST(NULL AS STRING) AS empty_txt
FROM {lineitem} lineitem JOIN {orders} orders ON o_orderkey = l_orderkey
JOIN {customer} customer ON c_custkey = o_custkey JOIN {part} part ON p_partkey = l_partkey
"""
_COLUMNS = ("idx", "order_date_txt", "customer_txt", "size_txt", "qty_txt", "rate_txt", "amount_txt", "note_txt")

#: With rows without any value (C1), and the column that a spreadsheet's export adds (B2).
DIRTY_SALES_SQL = "SELECT " + ", ".join(f"CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE {c} END AS {c}" for c in _COLUMNS) + f""",
  empty_txt, CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE 'x' END AS unnamed_8 FROM ({_DEFECTS_SQL}) AS defects"""


def dirty_sales_sql_for_duckdb() -> str:
    return (DIRTY_SALES_SQL.replace("{lineitem} lineitem", "lineitem").replace("{orders} orders", "orders")
            .replace("{customer} customer", "customer").replace("{part} part", "part"))


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the fact scan is spread first: every output row is built by string work
    return spark.sql(DIRTY_SALES_SQL, lineitem=spread(load(spark, sf_dir, "lineitem")),
                     orders=load(spark, sf_dir, "orders"), customer=load(spark, sf_dir, "customer"),
                     part=load(spark, sf_dir, "part"))
