"""The tables that queries read, and readings of them as models: each gives the columns that an operator asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswalk.operators.decide import resolve


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every tenth vector) and targets (the others)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return v.where("id % 10 = 0"), v.where("id % 10 <> 0")


#: types and what they have: a brand has the properties that its parts' types are
def model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts (orders), their properties (line items) and what target types (return flags' brands) have.

    An order's target is its priority; every seventh order has none. A line item's target is its return flag and line status; those returned are
    undecided every fifth time and have none every third. A priority has the pairs that its number allows.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    concepts = orders.select(F.concat(F.lit("src:C"), F.col("o_orderkey").cast("string")).alias("concept"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("nc:"), F.substring("o_orderpriority", 1, 1), F.lit("Type"))).alias("target"), F.col("o_orderkey").alias("pos"))
    pair = F.concat(F.lit("nc:"), F.col("l_returnflag"), F.col("l_linestatus"))
    target = F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 5 == 0), "[undecided]").when(F.col("l_partkey") % 3 != 0, pair)
    props = table(spark, d, "lineitem").select(F.concat(F.lit("src:C"), F.col("l_orderkey").cast("string")).alias("concept"), F.concat(F.lit("src:p"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("name"), target.alias("target"), (F.col("l_suppkey") % 4 == 0).alias("guess"))
    has = orders.select(F.concat(F.lit("nc:"), F.substring("o_orderpriority", 1, 1), F.lit("Type")).alias("type"), F.substring("o_orderpriority", 1, 1).cast("int").alias("n")).distinct()
    pairs = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).distinct()
    has = has.join(pairs, (F.ascii("f") + F.ascii("s") + F.col("n")) % 2 == 0).select("type", F.concat(F.lit("nc:"), "f", "s").alias("property"))
    return concepts, props, has


MODEL_SQL = """concepts AS (SELECT 'src:C' || o_orderkey AS concept, CASE WHEN o_orderkey % 7 <> 0 THEN 'nc:' || substr(o_orderpriority, 1, 1) || 'Type' END AS target, o_orderkey AS pos FROM orders),
props AS (SELECT 'src:C' || l_orderkey AS concept, 'src:p' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS name,
 CASE WHEN l_returnflag = 'R' AND l_partkey % 5 = 0 THEN '[undecided]' WHEN l_partkey % 3 <> 0 THEN 'nc:' || l_returnflag || l_linestatus END AS target, l_suppkey % 4 = 0 AS guess FROM lineitem),
has AS (SELECT DISTINCT 'nc:' || p || 'Type' AS type, 'nc:' || f || s AS property FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS p FROM orders)
 JOIN (SELECT DISTINCT l_returnflag AS f, l_linestatus AS s FROM lineitem) ON (ascii(f) + ascii(s) + p::INT) % 2 = 0),
bucketed AS (SELECT p.concept, CASE WHEN p.target IS NULL OR p.target = '[undecided]' THEN 'not_found' WHEN h.type IS NOT NULL THEN 'on_target' ELSE 'elsewhere' END AS bucket
 FROM props p JOIN concepts c USING (concept) LEFT JOIN has h ON h.type = c.target AND h.property = p.target),
counted AS (SELECT c.concept, c.target, c.pos, count(*) FILTER (bucket = 'on_target') AS on_target, count(*) FILTER (bucket = 'elsewhere') AS elsewhere, count(*) FILTER (bucket = 'not_found') AS not_found
 FROM concepts c LEFT JOIN bucketed b USING (concept) GROUP BY ALL),
matrix AS (SELECT *, CASE WHEN target IS NULL THEN 'extend' WHEN elsewhere + not_found = 0 THEN 'reuse' WHEN elsewhere >= not_found THEN 'augment' ELSE 'extend' END AS action,
 CASE WHEN pos % 3 = 0 THEN 'pending-review' ELSE 'accepted' END AS "reviewStatus", CASE WHEN pos % 4 = 0 THEN 'best-guess' WHEN pos % 4 = 1 THEN 'confident' END AS confidence FROM counted),
pm AS (SELECT *, CASE WHEN target IS NULL THEN 'create-property' WHEN target = '[undecided]' THEN 'human-must-decide' ELSE 'reuse-property' END AS action,
 CASE WHEN guess THEN 'best-guess' END AS confidence FROM props)"""


def matrix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Resolved classes with review status and confidence, and their properties with actions."""
    from crosswalk.operators.decide import property_action

    concepts, props, has = model(spark, d)
    m = resolve(concepts, props, has, "structures:ObjectType")
    status = F.when(F.col("pos") % 3 == 0, "pending-review").otherwise("accepted")
    conf = F.when(F.col("pos") % 4 == 0, "best-guess").when(F.col("pos") % 4 == 1, "confident")
    return m.withColumns({"reviewStatus": status, "confidence": conf}), props.withColumns({"action": property_action(F.col("target")), "confidence": F.when(F.col("guess"), "best-guess")})
