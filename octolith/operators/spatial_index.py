"""Two-dimensional spatial index: quadtree cells with intervals of point numbers.

A cell is numbered by its level's offset plus a path of two bits per level (x lowest).  Queries go
from an area to cells, from cells to intervals, from intervals to points, and check the points again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Points are looked up by blocks of so many numbers, which turns "between" into an equality first.
PID_BLOCK = 1024


@dataclass(frozen=True)
class Grid:
    """A square of 2^levels cells around a box, which is snapped to cells and padded on both sides."""

    min_x: float
    min_y: float
    cell: float
    levels: int

    @staticmethod
    def around(low: tuple[float, float], high: tuple[float, float], cell: float = 100.0) -> Grid:
        start = [cell * (int(v / cell) - (v < 0)) for v in low]
        stop = [cell * (int(v / cell) + (v >= 0)) for v in high]
        count = [max(1, int((b - a) / cell + 0.5)) for a, b in zip(start, stop, strict=True)]
        levels = (max(count) - 1).bit_length()
        spare = [(1 << levels) - n for n in count]
        return Grid(*[a - cell * (s - s // 2) for a, s in zip(start, spare, strict=True)], cell, levels)

    @property
    def side(self) -> int:
        return 1 << self.levels


def level_offset(level: int) -> int:
    """Number of cells of all levels above."""
    return ((1 << 2 * level) - 1) // 3


def interleave(cx: Column, cy: Column, bits: int) -> Column:
    """x at the even places, y at the odd ones."""
    out = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(cx, k).bitwiseAND(one), 2 * k)).bitwiseOR(F.shiftleft(F.shiftright(cy, k).bitwiseAND(one), 2 * k + 1))
    return out


def grid_cell(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor((x - F.lit(grid.min_x)) / F.lit(grid.cell)), F.floor((y - F.lit(grid.min_y)) / F.lit(grid.cell))


def cell_index(grid: Grid, x: Column, y: Column) -> Column:
    cx, cy = grid_cell(grid, x, y)
    return F.lit(level_offset(grid.levels)) + interleave(cx, cy, grid.levels)


def subtile_index(grid: Grid, x: Column, y: Column, tile: int, tile_level: int) -> Column:
    """A cell's number in the index of one tile (a cell of level ``tile_level``) of a larger tree: levels count from the tile. Null outside the tile."""
    if not 0 <= tile_level <= grid.levels or not level_offset(tile_level) <= tile < level_offset(tile_level + 1):
        raise ValueError("a tile is a cell between the root and the finest level")
    deep = grid.levels - tile_level
    path = cell_index(grid, x, y) - F.lit(level_offset(grid.levels))
    inside = F.shiftright(path, 2 * deep) == F.lit(tile - level_offset(tile_level))
    return F.when(inside, F.lit(level_offset(deep)) + path.bitwiseAND(F.lit((1 << 2 * deep) - 1).cast("long")))


def whole_index(grid: Grid, cell: Column, tile: int, tile_level: int) -> Column:
    """The number in the whole tree of a cell of the finest level of a tile's index."""
    deep = grid.levels - tile_level
    return F.lit(level_offset(grid.levels) + ((tile - level_offset(tile_level)) << 2 * deep)).cast("long") + (cell - F.lit(level_offset(deep)))


def tile_of(grid: Grid, cell: Column, tile_level: int) -> Column:
    """The tile (a cell of a coarser level) that holds a cell of the finest level."""
    return F.shiftright(cell - F.lit(level_offset(grid.levels)), 2 * (grid.levels - tile_level)) + F.lit(level_offset(tile_level))


def intervals(cells: DataFrame, threshold: int = 1000) -> DataFrame:
    """(cell, start, end, full): runs of pid per cell, cut where the gap exceeds the threshold.

    A cell may hold most points: a run is made first within blocks of pid, and only the blocks' runs meet per cell.
    """
    rows = cells.select("cell", "pid", F.floor(F.col("pid") / (PID_BLOCK * 64)).alias("_block"))
    return _islands(_islands(rows.select("cell", "_block", F.col("pid").alias("start"), F.col("pid").alias("end"), F.lit(1).cast("long").alias("full")), ["cell", "_block"], threshold), ["cell"], threshold)


def _islands(runs: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(w)
    rows = runs.withColumn("_new", F.when(gap <= threshold, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("full").alias("full")).select(*keys, "start", "end", "full")


def union_intervals(some: DataFrame) -> DataFrame:
    """(start, end): intervals of several cells as one set, overlapping and adjacent ones joined.

    Points belong to one cell each, but intervals of different cells may overlap, as gaps below the threshold belong to them.
    Stretches of numbers are joined on their own first, then longer ones, so the last step sees what is left apart in stretches of 6 * 10^10 numbers.
    """
    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("start", "end")
        before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_new", F.when(F.col("start") <= before + 1, 0).otherwise(1))
        rows = rows.withColumn("_island", F.sum("_new").over(w))
        return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")

    rows = some.select("start", "end")
    for width in (PID_BLOCK * 64, PID_BLOCK * 64 * 1024, PID_BLOCK * 64 * 1024 * 1024):
        rows = joined(rows.select("start", "end", F.floor(F.col("start") / width).alias("_block")), ["_block"]).select("start", "end")
    return joined(rows, [])


def keep_largest_gaps(some: DataFrame, maximum: int) -> DataFrame:
    """At most ``maximum`` intervals (a negative number: that many per cell on average), by closing the smallest gaps.

    Every cell keeps one interval.  Of equal gaps, those that start first stay.  The number of gaps to keep
    is found by a top-k, not by a sort of all gaps.
    """
    w = Window.partitionBy("cell").orderBy("start")
    gaps = some.withColumn("_gap", F.col("start") - F.lag("end").over(w) - 1)
    if not maximum:
        return some
    cells = some.select("cell").distinct().count()
    keep = max((maximum if maximum > 0 else -maximum * cells) - cells, 0)
    top = gaps.filter("_gap IS NOT NULL").orderBy(F.desc("_gap"), "start", "cell").limit(keep).select(F.col("cell").alias("_c"), F.col("start").alias("_s"))
    marked = gaps.join(top, (F.col("cell") == F.col("_c")) & (F.col("start") == F.col("_s")), "left")
    first = marked.withColumn("_new", F.when(F.col("_gap").isNull() | F.col("_s").isNotNull(), 1).otherwise(0))
    island = first.withColumn("_island", F.sum("_new").over(w))
    return island.groupBy("cell", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("full").alias("full")).drop("_island")


def coarsen_step(counts: DataFrame, level: int, minimum: int) -> DataFrame:
    """(cell, n) after one step at a level: four siblings with fewer than ``minimum`` points together become their parent."""
    up = (F.shiftright(F.col("cell") - F.lit(level_offset(level)), 2) + F.lit(level_offset(level - 1))).alias("parent")
    here = counts.filter(F.col("cell").between(level_offset(level), level_offset(level + 1) - 1)).select("cell", "n", up)
    merged = here.groupBy("parent").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).filter((F.col("k") == 4) & (F.col("n") < minimum))
    kept = here.join(merged.select(F.col("parent").alias("_p")), F.col("parent") == F.col("_p"), "left_anti").select("cell", "n")
    others = counts.filter(~F.col("cell").between(level_offset(level), level_offset(level + 1) - 1)).select("cell", "n")
    return kept.unionByName(merged.select(F.col("parent").alias("cell"), "n")).unionByName(others)


def coarsen(counts: DataFrame, levels: int, minimum: int = 100_000, materialize: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Steps from the finest level up; a parent made by one step takes part in the next.

    A step reads its input three times: ``materialize`` (a table in shared storage) keeps the plan from growing with each.
    """
    for level in range(levels, 0, -1):
        counts = materialize(coarsen_step(counts, level, minimum))
    return counts


def cell_boxes(spark: SparkSession, grid: Grid, level: int | None = None) -> DataFrame:
    """(cell, x0, x1, y0, y1) of all cells of a level."""
    level = grid.levels if level is None else level
    side, edge = 1 << level, grid.cell * (1 << (grid.levels - level))
    n = spark.range(side * side).select((F.col("id") % side).alias("cx"), F.floor(F.col("id") / side).alias("cy"))
    x0, y0 = F.lit(grid.min_x) + F.col("cx") * edge, F.lit(grid.min_y) + F.col("cy") * edge
    return n.select((F.lit(level_offset(level)) + interleave(F.col("cx"), F.col("cy"), level)).alias("cell"), x0.alias("x0"), (x0 + edge).alias("x1"), y0.alias("y0"), (y0 + edge).alias("y1"))


def boxes_of_cells(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds x0, x1, y0, y1 to cells of any levels: the path's bits, taken apart."""
    level = F.lit(0)
    for k in range(1, grid.levels + 1):
        level = F.when(F.col("cell") >= level_offset(k), k).otherwise(level)
    path = F.col("cell") - F.element_at(F.array(*[F.lit(level_offset(k)) for k in range(grid.levels + 1)]), F.col("_level") + 1)
    one = F.lit(1).cast("long")

    def part(odd: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(grid.levels):
            out = out.bitwiseOR(F.shiftleft(F.shiftright("_path", 2 * k + odd).bitwiseAND(one), k))
        return out

    rows = cells.withColumn("_level", level).withColumn("_path", path)
    edge = F.lit(grid.cell) * F.pow(F.lit(2.0), F.lit(grid.levels) - F.col("_level"))
    rows = rows.withColumns({"_edge": edge, "_cx": part(0), "_cy": part(1)})
    x0, y0 = F.lit(grid.min_x) + F.col("_cx") * F.col("_edge"), F.lit(grid.min_y) + F.col("_cy") * F.col("_edge")
    return rows.withColumns({"x0": x0, "y0": y0, "x1": x0 + F.col("_edge"), "y1": y0 + F.col("_edge")}).drop("_level", "_path", "_edge", "_cx", "_cy")


def meets_rectangle(low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Half-open boxes overlap."""
    return (F.col("x0") < high[0]) & (F.col("x1") > low[0]) & (F.col("y0") < high[1]) & (F.col("y1") > low[1])


def meets_circle(x: float, y: float, radius: float) -> Column:
    dx = F.greatest(F.col("x0") - x, F.lit(x) - F.col("x1"), F.lit(0.0))
    dy = F.greatest(F.col("y0") - y, F.lit(y) - F.col("y1"), F.lit(0.0))
    return dx * dx + dy * dy < radius * radius


def in_rectangle(low: tuple[float, float], high: tuple[float, float]) -> Column:
    return (F.col("x") >= low[0]) & (F.col("x") < high[0]) & (F.col("y") >= low[1]) & (F.col("y") < high[1])


def in_circle(x: float, y: float, radius: float) -> Column:
    return (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) < radius * radius


def points_of(points: DataFrame, some: DataFrame) -> DataFrame:
    """Points whose pid lies in an interval: an equality on blocks of pid, then the bounds.  A semi-join: overlapping intervals give no duplicates.

    Blocks grow with the interval (by powers of 64, a block is as long as the interval at least), so an interval is two rows at most, and a point asks for
    the blocks of each size that intervals have: two small joins' worth of keys, not one row per block of a long run.
    """
    size, steps = F.lit(0), 6
    for k in range(1, steps):
        size = F.when(F.col("end") - F.col("start") >= PID_BLOCK * 64 ** (k - 1), k).otherwise(size)
    width = F.element_at(F.array(*[F.lit(PID_BLOCK * 64**k) for k in range(steps)]), F.col("_size") + 1)
    spans = some.select("start", "end", size.alias("_size")).withColumn("_width", width)
    spans = spans.select("start", "end", "_size", F.explode(F.sequence(F.floor(F.col("start") / F.col("_width")), F.floor(F.col("end") / F.col("_width")))).alias("_block"))
    sizes = sorted(r[0] for r in spans.select("_size").distinct().collect())  # six at most
    found = None
    for k in sizes:
        rows = points.withColumn("_at", F.floor(F.col("pid") / (PID_BLOCK * 64**k)))
        here = spans.filter(F.col("_size") == k)
        hit = rows.join(here, (F.col("_at") == F.col("_block")) & F.col("pid").between(F.col("start"), F.col("end")), "left_semi").drop("_at")
        found = hit if found is None else found.unionByName(hit)
    return found.dropDuplicates(["pid"]) if len(sizes) > 1 else points.filter(F.lit(False)) if found is None else found


def query(points: DataFrame, index: DataFrame, grid: Grid, meets: Column, inside: Column) -> DataFrame:
    """Points (pid, x, y) in an area, through the index (cell, start, end; cells of any levels)."""
    hit = boxes_of_cells(index.select("cell", "start", "end"), grid).filter(meets)
    return points_of(points, hit).filter(inside)


def occupancy(cells: DataFrame, grid: Grid, level: int) -> DataFrame:
    """Cells of a coarser level that hold points."""
    return cells.select(tile_of(grid, F.col("cell"), level).alias("cell")).distinct()


def summary(some: DataFrame) -> DataFrame:
    """Cells, intervals, points in them and numbers that they span."""
    per_cell = some.groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.sum("full").alias("full"), F.sum(F.col("end") - F.col("start") + 1).alias("total"))
    return per_cell.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("k").alias("n_intervals"), F.sum("full").alias("n_full"), F.sum("total").alias("n_total"))


def write_index(some: DataFrame, path: str) -> None:
    some.select("cell", "start", "end", "full").repartitionByRange("cell").sortWithinPartitions("cell", "start").write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("cell long, start long, end long, full long").parquet(path)
