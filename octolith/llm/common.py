"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octolith.storage import discard, scratch_path, stored

__all__ = ["WORD", "ascii_lower", "discard", "grouped_rank", "materialize", "scratch_path", "table", "word_count"]

#: What a word is everywhere here: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Write to the shared folder and read again: cuts the lineage, survives lost executors.
materialize = stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also change other letters)."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def grouped_rank(df: DataFrame, keys: list[str], order: list[str | Column], block: Column, out: str = "rank") -> DataFrame:
    """Rank (from 0) of each row among those with equal ``keys``, in the order (block, ``order``).

    A plain window over ``keys`` would put a hot key in one task.  Here a task sorts one
    (keys, block) group; the blocks' sizes are summed first (partial aggregation), and only one row
    per block meets in the window over ``keys``.
    """
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(inside) - 1)
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(starts, same).withColumn(out, F.col("_start") + F.col("_r")).drop("_block", "_r", "_b", "_start", *[f"_k{i}" for i in range(len(keys))])
