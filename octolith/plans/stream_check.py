"""The streaming build as queries: its results are the tables of a single batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.config import TreeConfig
from octolith.plans import catalogue
from octolith.plans.adaptors import EVENTS, event_points
from octolith.storage import scratch_path
from octolith.streaming.build import BuildState, read_stream, start, step

CONFIG = TreeConfig(max_points=50, max_depth=5, grid=16)
SQL = f"WITH {EVENTS} SELECT l::INTEGER AS level, px >> (28 - l) AS nx, py >> (28 - l) AS ny, pz >> (28 - l) AS nz, count(*) AS n_points FROM pts, range(0, 6) AS t(l) GROUP BY ALL"


def stream_equals_batch(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """Point files in several micro-batches, then the counts of the last committed state."""
    return _built(spark, sf_dir, batches).node_counts(spark)


def _built(spark: SparkSession, sf_dir: str, batches: int = 4, max_points: int | None = None) -> BuildState:
    folder = scratch_path(spark, "stream")
    points = event_points(spark, sf_dir).select("pid", "px", "py", "pz", "color")
    points.repartition(batches, "pid").write.mode("overwrite").parquet(f"{folder}/in")
    state = BuildState(f"{folder}/state", CONFIG)
    start(read_stream(spark, f"{folder}/in", points.schema), state, max_points=max_points).awaitTermination()
    return state


def stream_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The voxels of the last committed state."""
    return _built(spark, sf_dir).voxels(spark)


def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 700 points: what was built and what was left out."""
    return _built(spark, sf_dir, max_points=700).capacity(spark)


def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One micro-batch at a time: a row per step with the points processed so far."""
    folder = scratch_path(spark, "steps")
    points = event_points(spark, sf_dir).select("pid", "px", "py", "pz")
    for k in range(3):
        points.filter(F.col("pid") % 3 == k).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in{k}")
    schema, state, rows = points.schema, BuildState(f"{folder}/state", CONFIG), []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in*")
    while step(stream, state):
        rows.append((len(rows) + 1, state.processed(spark)))
    return spark.createDataFrame(sorted(rows), "step int, n_points long").select("step", (F.col("n_points") == F.lit(points.count())).alias("is_whole"))


QUERIES = {"stream_equals_batch": stream_equals_batch, "stream_voxels": stream_voxels, "stream_budget": stream_budget, "stream_steps": stream_steps}
ORACLES = {
    "stream_equals_batch": SQL,
    "stream_voxels": catalogue._tree(EVENTS, CONFIG) + "SELECT * FROM vox",
    "stream_budget": "SELECT sum((event_id < 700)::BIGINT)::BIGINT AS n_points, sum((event_id >= 700)::BIGINT)::BIGINT AS n_left_out, max(event_id) >= 700 AS is_full FROM events",
    "stream_steps": "SELECT k::INTEGER AS step, k = 3 AS is_whole FROM range(1, 4) AS t(k)",
}
