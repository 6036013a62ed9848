"""Schema analysis over a column catalog (J1-J10, J12 as Spark expressions).

Input is a ``columns`` DataFrame as produced by ``profile.column_profile``
(one row per table/file and column), so the rules run over lakes with
thousands of files as ordinary grouped jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _has(*words) -> Column:
    name = F.lower(F.col("column_name"))
    return reduce(lambda a, b: a | b, [name.contains(w) for w in words])


def semantic_type(unique_count="unique_count", n="n") -> Column:
    """J3, first rule wins (``id`` also hits names such as "width")."""
    ratio = F.try_divide(F.col(unique_count), F.col(n))
    return (F.when(_has("id", "index"),
                   F.when(F.col(unique_count) == F.col(n), "unique_identifier").otherwise("identifier"))
             .when(_has("date", "time", "month", "year"), "temporal")
             .when(F.col("kind") == "numeric",
                   F.when(_has("price", "mrp", "rate", "amount", "total", "tp"), "monetary")
                    .when(_has("qty", "quantity", "pcs", "weight"), "quantity")
                    .when(F.coalesce((F.col("min_num") >= 0) & (F.col("max_num") < 10000), F.lit(False)), "count")
                    .otherwise("numeric"))
             .when(F.col("kind") == "string",
                   F.when(ratio < 0.05, "categorical_low").when(ratio < 0.5, "categorical_high").otherwise("text"))
             .otherwise("unknown"))


def business_meaning() -> Column:
    """J4, in rule order."""
    return (F.when(_has("sku", "product", "style", "catalog", "item"), "product_identifier")
             .when(_has("category", "type", "class"), "product_category")
             .when(_has("customer", "client"), "customer_identifier")
             .when(_has("mrp", "price", "rate"), "pricing")
             .when(_has("amount", "total", "gross"), "transaction_amount")
             .when(_has("weight"), "logistics_weight")
             .when(_has("size"), "product_size")
             .when(_has("amazon", "flipkart", "myntra", "ajio", "paytm", "snapdeal"), "sales_channel_price")
             .when(_has("date", "month", "year"), "temporal_dimension")
             .otherwise("general"))


def sql_type(semantic: str = "inferred_type") -> Column:
    """Recommended SQL type from dtype and semantic type."""
    d = F.col("dtype")
    return (F.when(d.isin("bigint", "int", "smallint", "tinyint"), "INTEGER")
             .when(d.isin("double", "float"), F.when(F.col(semantic) == "monetary", "DECIMAL(15,2)").otherwise("DOUBLE"))
             .when(d == "string", F.when(F.col(semantic) == "temporal", "DATE")
                   .when(F.col("unique_pct") > 90, "TEXT").otherwise("VARCHAR(255)"))
             .otherwise("VARCHAR(255)"))


def annotate(columns: DataFrame) -> DataFrame:
    """J3 + J4 + J9 columns added to a catalog."""
    c = columns.withColumn("inferred_type", semantic_type()).withColumn("business_meaning", business_meaning())
    return c.withColumn("sql_type", sql_type())


def file_types(columns: DataFrame) -> DataFrame:
    """Per table, TRANSACTIONAL if >= 3 of {customer, date, amount/total/
    gross, quantity/pcs} occur in the names, else PRODUCT_CATALOG if >= 3 of
    {sku/style/catalog, mrp/price, category/type, >= 2 platform columns}, else
    UNKNOWN; with the business domain label."""
    def anyc(*w):
        return F.max(_has(*w).cast("int"))
    g = columns.groupBy("table_name").agg(
        (anyc("customer") + anyc("date") + anyc("amount", "total", "gross") + anyc("quantity", "pcs"))
        .alias("tx"),
        (anyc("sku", "style", "catalog") + anyc("mrp", "price") + anyc("category", "type")
         + (F.sum(_has("amazon", "flipkart", "myntra").cast("int")) >= 2).cast("int")).alias("cat"))
    ft = F.when(F.col("tx") >= 3, "TRANSACTIONAL").when(F.col("cat") >= 3, "PRODUCT_CATALOG").otherwise("UNKNOWN")
    return g.select("table_name", ft.alias("file_type")).withColumn(
        "business_domain", F.when(F.col("file_type") == "TRANSACTIONAL", "Sales Transactions")
        .when(F.col("file_type") == "PRODUCT_CATALOG", "Product Master Data").otherwise("Unknown"))


def key_entities(columns: DataFrame) -> DataFrame:
    """``(table, entity)`` for Customer, Product, Time, Transaction, Sales_Channel."""
    ent = F.array(F.when(_has("customer"), "Customer"), F.when(_has("product", "style", "sku"), "Product"),
                  F.when(_has("date", "month"), "Time"), F.when(_has("amount", "total", "gross"), "Transaction"),
                  F.when(_has("amazon", "flipkart", "myntra"), "Sales_Channel"))
    return columns.select("table_name", F.explode(F.array_compact(ent)).alias("entity")).distinct()


def common_columns(columns: DataFrame) -> DataFrame:
    """Names present in every table (case-sensitive)."""
    n = columns.select(F.count_distinct("table_name")).scalar()
    return (columns.groupBy("column_name").agg(F.count_distinct("table_name").alias("k"))
                   .where(F.col("k") == n).select("column_name"))


def unique_columns(columns: DataFrame) -> DataFrame:
    """``(table, column_name)`` for names found in exactly one table."""
    single = columns.groupBy("column_name").agg(F.count_distinct("table_name").alias("k")).where("k = 1")
    return columns.join(single, "column_name", "left_semi").select("table_name", "column_name")


def compatibility(types: DataFrame) -> DataFrame:
    """One row with the compatibility verdict and strategy over the J5
    output (needs at least two tables)."""
    g = types.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("file_type").alias("kinds"),
                  F.max((F.col("file_type") == "UNKNOWN").cast("int")).alias("has_unknown"))
    return g.where("files >= 2").select(
        F.when(F.col("kinds") == 1, "COMPATIBLE - Same file type")
         .when(F.col("has_unknown") == 0, "INCOMPATIBLE - Different file types (requires separate tables)")
         .otherwise("PARTIAL - Manual inspection required").alias("schema_compatibility"),
        F.when(F.col("kinds") == 1, "VERTICAL_UNION - Stack all files with same schema")
         .otherwise("SEPARATE_TABLES - Create different tables for different file types, link via foreign keys")
         .alias("unification_strategy"))


def recommendations(columns: DataFrame, types: DataFrame) -> DataFrame:
    """J7 advice rules as rows ``(seq, recommendation)``."""
    t = types.agg(F.max((F.col("file_type") == "TRANSACTIONAL").cast("int")).alias("tx"),
                  F.max((F.col("file_type") == "PRODUCT_CATALOG").cast("int")).alias("cat"),
                  F.count_distinct("file_type").alias("kinds"), F.count(F.lit(1)).alias("files"))
    fixed = [
        (1, "tx = 1 AND cat = 1", "Create a STAR SCHEMA with fact table (transactions) and dimension table (products)"),
        (2, "tx = 1 AND cat = 1", "Link transactions to product catalog via SKU/Product ID"),
        (3, "tx = 1 AND cat = 1", "Consider creating a unified product master from catalog data"),
        (4, "kinds = 1 AND tx = 1", "All files are transactional - can be combined into single fact table"),
        (5, "kinds = 1 AND tx = 1", "Add a 'source_file' column to track data origin"),
        (6, "kinds = 1 AND tx = 1", "Standardize column names across all files before union"),
        (7, "files > 3", "Consider partitioning data by date/month for better query performance"),
        (8, "files > 3", "Create aggregated summary tables for faster reporting"),
    ]
    rec = t.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("seq"), F.when(F.expr(cond), F.lit(txt)).alias("recommendation"))
        for s, cond, txt in fixed])).alias("r")).select("r.*").where(F.col("recommendation").isNotNull())
    per = columns.join(types.where(F.col("file_type") == "TRANSACTIONAL"), "table_name").groupBy("table_name").agg(
        F.max(_has("date").cast("int")).alias("d"), F.max(_has("customer").cast("int")).alias("c"))
    miss = per.select(F.explode(F.array(
        F.when(F.col("d") == 0, F.struct(F.lit(100).alias("seq"), F.concat(
            F.lit("⚠️  "), F.col("table_name"), F.lit(": Missing date/time column - may limit temporal analysis"))
            .alias("recommendation"))),
        F.when(F.col("c") == 0, F.struct(F.lit(101).alias("seq"), F.concat(
            F.lit("⚠️  "), F.col("table_name"), F.lit(": Missing customer identifier - limits customer analytics"))
            .alias("recommendation"))))).alias("r")).where(F.col("r").isNotNull()).select("r.*")
    return rec.unionByName(miss)


def union_by_type(frames: dict, loaded_at=None) -> DataFrame:
    """J8 ``by_type``: rows of several tables of one type stacked by column
    name (missing columns null) with provenance ``source_file`` and ``loaded_at``."""
    ts = F.current_timestamp() if loaded_at is None else F.lit(loaded_at).cast("timestamp")
    out = None
    for name, df in frames.items():
        df = df.withColumn("source_file", F.lit(name)).withColumn("loaded_at", ts)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def column_kind(role_columns: Column | None = None) -> Column:
    """J10 (explorer): MOSTLY_NULL, DATE, METRIC/NUMERIC, CATEGORY, ID/TEXT, OTHER.
    ``role_columns`` is a boolean Column: the column is a quantity/rate/amount role."""
    ratio = F.try_divide(F.col("unique_count"), F.col("n"))
    nonnull = F.col("n") - F.col("null_count")
    metric = role_columns if role_columns is not None else F.lit(False)
    return (F.when(nonnull < F.col("n") * 0.1, "MOSTLY_NULL")
             .when(_has("date"), "DATE")
             .when(F.col("kind") == "numeric", F.when(metric, "METRIC").otherwise("NUMERIC"))
             .when(F.col("kind") == "string",
                   F.when(ratio < 0.05, "CATEGORY").when(ratio > 0.95, "ID/TEXT").otherwise("CATEGORY"))
             .otherwise("OTHER"))


# Wanted dimension and metric names of the facts summary, by priority.
FACT_DIMENSIONS = ["region", "state", "store", "category", "subcategory", "product", "product_line",
                   "brand", "channel", "segment", "year", "quarter", "month", "date"]
FACT_METRICS = ["sales", "revenue", "amount", "profit", "margin", "units", "quantity"]


def fact_columns(columns: DataFrame) -> DataFrame:
    """``(table, use, column_name, priority)``: wanted dimensions and
    metrics present (list order), metrics falling back to numeric columns."""
    spark = columns.sparkSession
    wanted = spark.createDataFrame(
        [("dimension", w, i) for i, w in enumerate(FACT_DIMENSIONS)] +
        [("metric", w, i) for i, w in enumerate(FACT_METRICS)], "use string, wanted string, priority int")
    hit = columns.join(F.broadcast(wanted), F.lower(F.col("column_name")) == F.col("wanted")) \
                 .select("table_name", "use", "column_name", "priority")
    has_metric = hit.where("use = 'metric'").select("table_name").distinct()
    fallback = (columns.where(F.col("kind") == "numeric").join(has_metric, "table_name", "left_anti")
                       .select("table_name", F.lit("metric").alias("use"), "column_name",
                               (F.col("ordinal") + 1000).alias("priority")))
    return hit.unionByName(fallback)


def compare_prices(df: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """Price comparison of two providers.  Header-like labels (C4) are
    dropped, prices parsed as the first number in the text (B12), rows with no
    price at all dropped (C5); then per provider avg/min/max, how often each is
    cheaper (diff = b - a: > 0 -> a cheaper, < 0 -> b cheaper, 0 -> tie; a null
    diff counts nowhere) and the mean diff.  No row cap."""
    from tillpoint.functions.text import first_number
    from tillpoint.operators.clean import drop_label_headers, drop_rows_without

    d = drop_label_headers(df, label).select(F.col(label), first_number(a).alias("a"), first_number(b).alias("b"))
    d = drop_rows_without(d, ["a", "b"])
    diff = F.col("b") - F.col("a")
    return d.agg(F.count(F.lit(1)).alias("row_count"),
                 F.avg("a").alias("avg_a"), F.min("a").alias("min_a"), F.max("a").alias("max_a"),
                 F.avg("b").alias("avg_b"), F.min("b").alias("min_b"), F.max("b").alias("max_b"),
                 F.count_if(diff > 0).alias("cheaper_a"), F.count_if(diff < 0).alias("cheaper_b"),
                 F.count_if(diff == 0).alias("ties"), F.avg(diff).alias("avg_diff_b_minus_a"))
