"""The star tables as flow facts, labels, root descriptions and specs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..model import Level, QuerySpec

#: The three specs over the star: citations are line items, roots are supplier nations.
SPECS = {
    "q1": QuerySpec("q1", "Nation", (Level("Region", "cust"), Level("Nation", "cust"), Level("Brand", "part")), "Where and what", columns=("region", "nation", "brand")),
    "q2": QuerySpec("q2", "Nation", (Level("Type", "part"), Level("Brand", "part"), Level("Nation", "cust")), "What and where", columns=("type", "brand", "nation")),
    "q3": QuerySpec("q3", "Nation", (Level("Year", "time", '{"limit_n": 7}'), Level("Region", "cust"), Level("Nation", "cust")), "When and where", columns=("year", "region", "nation")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_type and its number; a handful of values, whatever the table's size."""
    kinds = table(spark, sf_dir, "part").select("p_type").distinct()
    return kinds.withColumn("type", F.dense_rank().over(Window.orderBy("p_type")))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: root and every attribute a spec may group by.

    Keys only: text columns stay in their dimensions, so the scan of lineitem
    reads four columns.  Spark picks broadcast or shuffle joins by size.
    """
    t = lambda name: table(spark, sf_dir, name)
    supplier = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("root"))
    customer = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    part = t("part").join(part_types(spark, sf_dir), "p_type").select("p_partkey", F.substring("p_brand", 7, 10).cast("int").alias("brand"), "type")
    orders = t("orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "nation", "region")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"))
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("root", "region", "nation", "brand", "type", "year", F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"))
    )


def attribute_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_type, id, name and meta (JSON text) of every attribute value."""
    t = lambda name: table(spark, sf_dir, name)
    row = lambda df, kind, id_, name, meta=None: df.select(F.lit(kind).alias("entity_type"), F.col(id_).cast("string").alias("id"), F.col(name).cast("string").alias("name"), (meta if meta is not None else F.lit("{}")).alias("meta"))
    nation = row(t("nation"), "Nation", "n_nationkey", "n_name", F.concat(F.lit('{"Region":"'), F.col("n_regionkey").cast("string"), F.lit('"}')))
    brand = t("part").select("p_brand").distinct().withColumn("id", F.substring("p_brand", 7, 10).cast("int"))
    year = t("lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return row(t("region"), "Region", "r_regionkey", "r_name").unionByName(nation).unionByName(row(brand, "Brand", "id", "p_brand")).unionByName(row(part_types(spark, sf_dir), "Type", "type", "p_type")).unionByName(row(year, "Year", "year", "year"))


def root_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root nations with papers (orders) and citations (line items) in their JSON meta."""
    counted = flow(spark, sf_dir).groupBy("root").agg(F.count_distinct("order_id").alias("papers"), F.count("*").alias("citations"))
    nation = table(spark, sf_dir, "nation")
    meta = F.when(F.col("citations").isNotNull(), F.to_json(F.struct("papers", "citations")))
    return nation.join(counted, F.col("n_nationkey") == F.col("root"), "left").select(F.lit("Nation").alias("entity_type"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), meta.alias("meta"))
