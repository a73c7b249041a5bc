"""The tree kept up to date by micro-batches.

The state is a table of counts per deepest cell and, where points have colours, one of the first point of each finest voxel; a batch has a folder of
its own in each, so a batch that runs again replaces what it wrote before.  Counts and firsts are mergeable: the
tree and the voxels of any moment are the closed form over all batches, and equal those of a single batch build.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from octolith.config import TreeConfig
from octolith.functions.lattice import AXES, LATTICE, node_coordinate, voxel_coordinate

COUNTS = "batch long, dx long, dy long, dz long, n long"
FIRSTS = "batch long, gx long, gy long, gz long, first struct<pid: long, color: long>"
LEFT_OUT = "batch long, n long"


@dataclass(frozen=True)
class BuildState:
    """Where a build keeps its tables; a new folder is a new build."""

    folder: str
    config: TreeConfig

    @property
    def counts_path(self) -> str:
        return f"{self.folder}/counts"

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    @property
    def firsts_path(self) -> str:
        return f"{self.folder}/firsts"

    @property
    def left_out_path(self) -> str:
        return f"{self.folder}/left_out"

    def add(self, points: DataFrame, batch: int, max_points: int | None = None) -> None:
        """One micro-batch; running it again gives the same folders.  Points numbered from ``max_points`` on are counted as left out."""
        if max_points is not None:
            points.filter(F.col("pid") >= max_points).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.left_out_path}/batch={batch}")
            points = points.filter(F.col("pid") < max_points)
        if "color" in points.columns and self.config.max_depth:
            fine = [voxel_coordinate(F.col(c), self.config.max_depth - 1, self.config.grid_bits).alias(f"g{a}") for c, a in zip(LATTICE, AXES, strict=True)]
            firsts = points.groupBy(*fine).agg(F.min(F.struct("pid", "color")).alias("first"))
            firsts.write.mode("overwrite").parquet(f"{self.firsts_path}/batch={batch}")
        cells = [node_coordinate(F.col(c), self.config.max_depth).alias(f"d{a}") for c, a in zip(LATTICE, AXES, strict=True)]
        points.select(*cells).groupBy(*[f"d{a}" for a in AXES]).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.counts_path}/batch={batch}")

    def counts(self, spark: SparkSession) -> DataFrame:
        """The sum of all committed batches: a snapshot that queries can read while the build goes on."""
        return self._read(spark, self.counts_path, COUNTS).groupBy("dx", "dy", "dz").agg(F.sum("n").alias("n"))

    def node_counts(self, spark: SparkSession) -> DataFrame:
        """(level, nx, ny, nz, n_points) of every occupied cell of every level."""
        levels = F.explode(F.array(*[F.lit(k) for k in range(self.config.max_depth + 1)])).alias("level")
        rows = self.counts(spark).select("*", levels)
        up = F.lit(self.config.max_depth) - F.col("level")
        return rows.groupBy("level", *[F.call_function("shiftright", F.col(f"d{a}"), up).alias(f"n{a}") for a in AXES]).agg(F.sum("n").alias("n_points"))

    def voxels(self, spark: SparkSession) -> DataFrame:
        """(node, vx, vy, vz, first_pid, color): the voxels of the tree of this moment."""
        config, g = self.config, [f"g{a}" for a in AXES]
        rows = self._read(spark, self.firsts_path, FIRSTS).groupBy(*g).agg(F.min("first").alias("first"))
        rows = rows.select(F.explode(F.sequence(F.lit(0), F.lit(max(0, config.max_depth - 1)))).alias("level"), *g, "first")
        up = F.lit(max(0, config.max_depth - 1)) - F.col("level")
        cells = rows.groupBy("level", *[F.call_function("shiftright", F.col(x), up).alias(x) for x in g]).agg(F.min("first").alias("first"))
        inner = self.node_counts(spark).filter((F.col("n_points") > config.max_points) & (F.col("level") < config.max_depth))
        inner = inner.select(F.col("level").alias("_l"), *[F.col(f"n{a}").alias(f"_{a}") for a in AXES])
        node = [F.shiftright(f"g{a}", config.grid_bits).alias(f"n{a}") for a in AXES]
        inside = [F.col(f"g{a}").bitwiseAND(F.lit(config.grid - 1)).alias(f"v{a}") for a in AXES]
        cells = cells.select("level", *node, *inside, F.col("first.pid").alias("first_pid"), F.col("first.color").alias("color"))
        return cells.join(inner, [F.col("level") == F.col("_l"), *[F.col(f"n{a}") == F.col(f"_{a}") for a in AXES]], "left_semi")

    def capacity(self, spark: SparkSession) -> DataFrame:
        """One row: points processed, points left out by the budget, and whether it was reached."""
        done = self.counts(spark).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"))
        left = self._read(spark, self.left_out_path, LEFT_OUT).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_left_out"))
        both = done.select("n_points", F.lit(0).cast("long").alias("n_left_out")).unionByName(left.select(F.lit(0).cast("long").alias("n_points"), "n_left_out"))
        return both.agg(F.sum("n_points").alias("n_points"), F.sum("n_left_out").alias("n_left_out")).withColumn("is_full", F.col("n_left_out") > 0)

    def _read(self, spark: SparkSession, path: str, schema: str) -> DataFrame:
        if not self._exists(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", path).parquet(path)

    def reset(self, spark: SparkSession) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def _exists(self, spark: SparkSession, path: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def processed(self, spark: SparkSession) -> int:
        return int(self.counts(spark).agg(F.sum("n")).first()[0] or 0)


def start(points: DataFrame, state: BuildState, *, max_points: int | None = None, once: bool = True) -> StreamingQuery:
    """Starts the build on a streaming table of lattice points; ``once``: all that is there, then stop.

    ``max_points`` is a budget: points numbered beyond it are left out, and counted (``BuildState.capacity``).
    """
    writer = points.writeStream.foreachBatch(lambda df, k: state.add(df, k, max_points)).option("checkpointLocation", state.checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def step(points: DataFrame, state: BuildState, *, max_points: int | None = None) -> bool:
    """Builds exactly one micro-batch and stops; false if there was none left.

    The query is stopped by an error in the batch after it, which is not committed and so runs as the next step.
    """
    done: list[int] = []

    def one(df: DataFrame, k: int) -> None:
        if done:
            raise RuntimeError("one step is enough")
        state.add(df, k, max_points)
        done.append(k)

    query = points.writeStream.foreachBatch(one).option("checkpointLocation", state.checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "one step is enough" not in str(e):
            raise
    return bool(done)


class Progress(StreamingQueryListener):
    """Calls back on each event of the session's streams: (name of the event, its details)."""

    def __init__(self, tell: Callable[[str, object], None]) -> None:
        self.tell = tell

    def onQueryStarted(self, event) -> None:
        self.tell("started", event)

    def onQueryProgress(self, event) -> None:
        self.tell("progress", event.progress)

    def onQueryIdle(self, event) -> None:
        self.tell("idle", event)

    def onQueryTerminated(self, event) -> None:
        self.tell("terminated", event)


def observed(rows: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """Rows as they are; the metrics (aggregates) are gathered on the way and told by ``Progress`` or an ``Observation``."""
    return rows.observe(name, *[c.alias(n) for n, c in metrics.items()])


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Point files as they arrive; the number per trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
