"""Training tables derived from the given parquet tables, each with its SQL twin.

Every fixture uses all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shard(column: str):
    return F.pmod(F.col(column), F.lit(SHARDS)).cast("int").alias("shard")


def ridge2(spark, sf_dir):
    """Lineitem: scaled price on quantity and discount."""
    return table(spark, sf_dir, "lineitem").select(
        _shard("l_orderkey"),
        (F.col("l_extendedprice") / 100000.0).alias("y"),
        F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0).alias("x"),
    )


RIDGE2 = """SELECT l_orderkey % 4 AS shard, l_extendedprice / 100000.0 AS y,
  l_quantity / 50.0 AS x0, l_discount * 10.0 AS x1 FROM lineitem"""


def orders2(spark, sf_dir):
    """Orders: the price as it is, on a constant and a scaled customer key."""
    return table(spark, sf_dir, "orders").select(
        _shard("o_orderkey"),
        F.col("o_totalprice").alias("y"),
        F.array(F.lit(1.0), (F.col("o_custkey") % 100) / 100.0).alias("x"),
    )


ORDERS2 = """SELECT o_orderkey % 4 AS shard, o_totalprice AS y,
  1.0::DOUBLE AS x0, (o_custkey % 100) / 100.0 AS x1 FROM orders"""


def ridge3(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        _shard("l_orderkey"),
        (F.col("l_extendedprice") / 100000.0).alias("y"),
        F.array(
            F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 12.5
        ).alias("x"),
    )


RIDGE3 = """SELECT l_orderkey % 4 AS shard, l_extendedprice / 100000.0 AS y,
  l_quantity / 50.0 AS x0, l_discount * 10.0 AS x1, l_tax * 12.5 AS x2 FROM lineitem"""


def logit2(spark, sf_dir):
    """Lineitem: returned or not, on quantity and discount."""
    return table(spark, sf_dir, "lineitem").select(
        _shard("l_orderkey"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y"),
        F.array(F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0).alias("x"),
    )


LOGIT2 = """SELECT l_orderkey % 4 AS shard,
  CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
  l_quantity / 50.0 AS x0, l_discount * 10.0 AS x1 FROM lineitem"""


def event2(spark, sf_dir):
    """Events: click or not, with a unique row id."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        _shard("event_id"),
        F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0).alias("y"),
        F.array(F.col("value") / 500.0, F.pmod("user_id", F.lit(10)) / 10.0).alias("x"),
    )


EVENT2 = """SELECT event_id AS id, event_id % 4 AS shard,
  CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
  value / 500.0 AS x0, (user_id % 10) / 10.0 AS x1 FROM events"""


def event_small(spark, sf_dir):
    """Events in shards of at most 100 rows: one batch a shard, so every epoch is one step."""
    return event2(spark, sf_dir).withColumn("shard", F.expr("cast(id div 100 AS INT)"))


EVENT_SMALL = f"SELECT id, (id // 100)::INTEGER AS shard, y, x0, x1 FROM ({EVENT2})"


def emb(spark, sf_dir):
    """Embeddings: upper against lower half of the ten labels, 64 features."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        _shard("vec_id"),
        F.when(F.col("label") >= 5, 1.0).otherwise(-1.0).alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


EMB = """SELECT vec_id AS id, vec_id % 4 AS shard,
  CASE WHEN label >= 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
  CAST(embedding AS DOUBLE[]) AS x FROM embeddings"""


def emb_products(spark, sf_dir):
    """The same rows with 2,304 features: products of the first 36 coordinates with all 64."""
    products = F.flatten(F.transform(F.slice("x", 1, 36), lambda a: F.transform("x", lambda b: a * b)))
    return emb(spark, sf_dir).withColumn("x", products)


EMB_PRODUCTS = f"""SELECT id, shard, y,
  [x[k // 64 + 1] * x[k % 64 + 1] FOR k IN range(2304)] AS x FROM ({EMB})"""
