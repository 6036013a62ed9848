"""K1: the star-schema sales view ``sales_wide``.

lineitem is the fact table; orders, customer, part, nation and region are
left-joined on their keys.  The reference only declares this model; we build it
so that the KPI block has a typed sales table to run on.

Scale notes
-----------
* The dimension keys are primary keys (each appears once in its table), so a
  left join from the fact table keeps every fact row exactly once.  That lets
  ``sales_wide(columns=...)`` leave out every join whose columns are not asked
  for: a KPI over ``l_*`` columns only scans lineitem.
* nation (25 rows) and region (5 rows) are fixed-size TPC-H tables and are
  broadcast explicitly.  orders, customer and part grow with the data: no hint
  is given, so AQE broadcasts them only when their runtime size is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and falls back to a
  shuffled join above it.
* ``fact_rollup`` aggregates the fact table on the foreign key *before* the
  join (aggregate pushdown, which Catalyst does not do by itself): the partial
  aggregate runs map-side, the shuffle carries one row per key, and the join
  meets the dimension table on an already hash-partitioned side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.sources.tables import load


@dataclass(frozen=True)
class Roles:
    """Which column plays which business role (J11 fills it when absent)."""

    amount: str | None = None
    quantity: str | None = None
    rate: str | None = None
    date: str | None = None
    customer: str | None = None
    product: str | None = None
    sku: str | None = None
    category: str | None = None
    channel: str | None = None
    region: str | None = None
    size: str | None = None
    month: str | None = None


# Fixed role mapping of the star view (see FIXTURES §3).
SALES_WIDE_ROLES = Roles(
    amount="l_extendedprice", quantity="l_quantity", rate="p_retailprice",
    date="o_orderdate", customer="c_name", product="p_brand", sku="l_partkey",
    category="p_type", channel="o_orderpriority", region="r_name",
)

_DIM_PREFIX = {"o_": "orders", "c_": "customer", "p_": "part", "n_": "nation", "r_": "region"}
# a dimension needs the ones on its join path
_PATH = {
    "orders": ("orders",),
    "customer": ("orders", "customer"),
    "part": ("part",),
    "nation": ("orders", "customer", "nation"),
    "region": ("orders", "customer", "nation", "region"),
}


def _needed_dims(columns) -> set[str]:
    if columns is None:
        return {"orders", "customer", "part", "nation", "region"}
    need: set[str] = set()
    for c in columns:
        dim = _DIM_PREFIX.get(c[:2])
        if dim:
            need.update(_PATH[dim])
    return need


def sales_wide(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    """lineitem ⟕ orders ⟕ customer ⟕ part ⟕ nation ⟕ region.

    ``columns`` restricts the output and drops the joins it does not need.
    """
    need = _needed_dims(columns)
    df = load(spark, sf_dir, "lineitem")
    if "orders" in need:
        df = df.join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if "customer" in need:
        df = df.join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if "part" in need:
        df = df.join(load(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if "nation" in need:
        df = df.join(load(spark, sf_dir, "nation"),
                     F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if "region" in need:
        df = df.join(load(spark, sf_dir, "region"),
                     F.col("n_regionkey") == F.col("r_regionkey"), "left")
    if columns is not None:
        df = df.select(*columns)
    return df


def fact_rollup(spark: SparkSession, sf_dir: str, dim: str, amount: str | None = "l_extendedprice") -> DataFrame:
    """Per-value ``(label, total, n)`` of a sales_wide dimension column, computed
    with the fact table pre-aggregated on each foreign key along the join path.

    ``total`` is ``sum(amount)`` (null when every amount of the group is null),
    ``n`` the row count.  Equal to ``sales_wide().groupBy(dim)`` because every
    dimension key is unique; rows whose key finds no partner form the null group.
    """
    li = load(spark, sf_dir, "lineitem")
    amt = F.col(amount) if amount else F.lit(None).cast("double")
    if dim.startswith("l_"):
        return li.groupBy(F.col(dim).alias("label")).agg(F.sum(amt).alias("total"), F.count(F.lit(1)).alias("n"))
    if dim.startswith("p_"):
        part = load(spark, sf_dir, "part").select("p_partkey", dim)
        by_key = li.groupBy("l_partkey").agg(F.sum(amt).alias("t"), F.count(F.lit(1)).alias("c"))
        j = by_key.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
        return j.groupBy(F.col(dim).alias("label")).agg(F.sum("t").alias("total"), F.sum("c").alias("n"))
    # orders-side dimensions: roll up by order, then walk orders -> customer -> nation -> region
    by_order = li.groupBy("l_orderkey").agg(F.sum(amt).alias("t"), F.count(F.lit(1)).alias("c"))
    orders = load(spark, sf_dir, "orders")
    j = by_order.join(orders.select("o_orderkey", "o_custkey", *([dim] if dim.startswith("o_") else [])),
                      F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if dim.startswith("o_"):
        return j.groupBy(F.col(dim).alias("label")).agg(F.sum("t").alias("total"), F.sum("c").alias("n"))
    by_cust = j.groupBy("o_custkey").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    cust = load(spark, sf_dir, "customer")
    j = by_cust.join(cust.select("c_custkey", "c_nationkey", *([dim] if dim.startswith("c_") else [])),
                     F.col("o_custkey") == F.col("c_custkey"), "left")
    if dim.startswith("c_"):
        return j.groupBy(F.col(dim).alias("label")).agg(F.sum("t").alias("total"), F.sum("c").alias("n"))
    by_nation = j.groupBy("c_nationkey").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    j = by_nation.join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if dim.startswith("n_"):
        return j.groupBy(F.col(dim).alias("label")).agg(F.sum("t").alias("total"), F.sum("c").alias("n"))
    j = j.join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.groupBy(F.col(dim).alias("label")).agg(F.sum("t").alias("total"), F.sum("c").alias("n"))


def order_rollup(spark: SparkSession, sf_dir: str, amount: str = "l_extendedprice",
                 quantity: str | None = "l_quantity") -> DataFrame:
    """Per-order line aggregates joined to orders: ``o_*`` columns plus
    ``line_total`` (sum of amount), ``line_amounts`` (non-null amounts),
    ``line_rows`` (rows) and ``line_units`` (sum of quantity).

    Grouping lineitem by ``l_orderkey`` uses the very hash partitioning the join
    needs, so the pre-aggregation adds no shuffle and shrinks the fact side to
    one row per order.  Orders without lines get no row (inner join): every
    metric built on it filters on an order attribute anyway.
    """
    li = load(spark, sf_dir, "lineitem")
    aggs = [F.sum(amount).alias("line_total"), F.count(amount).alias("line_amounts"),
            F.count(F.lit(1)).alias("line_rows")]
    if quantity:
        aggs.append(F.sum(quantity).alias("line_units"))
    by_order = li.groupBy("l_orderkey").agg(*aggs)
    return by_order.join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "inner")
