"""Point tables made from the test tables, in integers below 2^20 per axis, and the SQL that makes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.config import Cube
from octolith.functions.colors import pack_color

CUBE = Cube(0.0, 0.0, 0.0, float(1 << 20))


def _finished(rows: DataFrame) -> DataFrame:
    pid = F.col("pid")
    rgb = {c: F.pmod(pid * k, F.lit(256)).cast("int") for c, k in (("r", 37), ("g", 101), ("b", 199))}
    rows = rows.withColumns(rgb)
    return rows.select("pid", *[F.col(a).cast("double").alias(a) for a in "xyz"], *[(F.col(a).cast("long") * 256).alias(f"p{a}") for a in "xyz"], "r", "g", "b", pack_color(F.col("r"), F.col("g"), F.col("b")).alias("color"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    z = ((F.day("ts") - 1) * 24 + F.hour("ts")) * 1024 + F.minute("ts") * 16 + F.floor(F.second("ts") / 4)
    return _finished(e.select(F.col("event_id").alias("pid"), (F.col("user_id") % 1024 * 1024).alias("x"), F.floor(F.col("value") * 1024).alias("y"), z.alias("z")))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a unique number: for operators that don't depend on the order."""
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _finished(e.select(F.col("l_orderkey").alias("pid"), F.floor(F.col("l_extendedprice") * 8).alias("x"), (F.col("l_partkey") % 2048 * 512).alias("y"), F.floor(F.col("l_quantity") * 16384).alias("z")))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _finished(e.select(F.col("vec_id").alias("pid"), *[F.floor((F.col("embedding")[k].cast("double") + 1) * 524288).alias(a) for k, a in enumerate("xyz")]))


_FINISH = """pts AS (SELECT pid, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, x * 256 AS px, y * 256 AS py, z * 256 AS pz,
    ((pid * 37) % 256)::INTEGER AS r, ((pid * 101) % 256)::INTEGER AS g, ((pid * 199) % 256)::INTEGER AS b,
    (pid * 37) % 256 + (pid * 101) % 256 * 256 + (pid * 199) % 256 * 65536 + 4278190080 AS color FROM raw)"""
EVENTS = f"""raw AS (SELECT event_id AS pid, (user_id % 1024 * 1024)::BIGINT AS x, floor(value * 1024)::BIGINT AS y,
    (((day(ts) - 1) * 24 + hour(ts)) * 1024 + minute(ts) * 16 + second(ts) // 4)::BIGINT AS z FROM events), {_FINISH}"""
LINES = f"""raw AS (SELECT l_orderkey AS pid, floor(l_extendedprice * 8)::BIGINT AS x, (l_partkey % 2048 * 512)::BIGINT AS y,
    floor(l_quantity * 16384)::BIGINT AS z FROM lineitem), {_FINISH}"""
EMBEDDINGS = f"""raw AS (SELECT vec_id AS pid, floor((embedding[1]::DOUBLE + 1) * 524288)::BIGINT AS x, floor((embedding[2]::DOUBLE + 1) * 524288)::BIGINT AS y,
    floor((embedding[3]::DOUBLE + 1) * 524288)::BIGINT AS z FROM embeddings), {_FINISH}"""
