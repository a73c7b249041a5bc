"""The tree in closed form.

A node of level L is a cell of the lattice shifted by L.  It is inner if it has more than ``max_points``
points and lies above the deepest level; counts only grow towards the root, so all its ancestors are
inner too.  A point belongs to the one node on its path that isn't inner but whose parent is.  Nothing
depends on batches or on the order in which points arrive.

Points here have pid, px, py, pz (28-bit lattice) and color.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from octolith.config import Cube, TreeConfig
from octolith.functions.lattice import AXES, LATTICE, NODE, child_index, node_coordinate, settled, voxel_coordinate

Materialize = Callable[[DataFrame], DataFrame]
#: Levels that are counted from one scan; only points below inner nodes go on to the next ones.
LEVELS_PER_PASS = 9
#: Levels of voxels that are made from the ones below at once; the next ones start from the coarsest of them.
VOXEL_LEVELS_PER_PASS = 8


def cell_counts(points: DataFrame, first: int, last: int) -> DataFrame:
    """Points per cell of the levels first..last: counted once at the deepest, then summed up the levels."""
    deep = points.groupBy(*[node_coordinate(F.col(c), last).alias(f"d{a}") for c, a in zip(LATTICE, AXES, strict=True)]).agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*[F.lit(k) for k in range(first, last + 1)])).alias("level")
    cells = deep.select("n", *[f"d{a}" for a in AXES], levels)
    up = F.lit(last) - F.col("level")
    return cells.groupBy("level", *[F.call_function("shiftright", F.col(f"d{a}"), up).alias(f"n{a}") for a in AXES]).agg(F.sum("n").alias("n_points"))


def node_counts(points: DataFrame, config: TreeConfig, materialize: Materialize = lambda df: df) -> DataFrame:
    """(level, nx, ny, nz, n_points) of every occupied cell whose parent is inner, and of the root.

    The levels are worked off in passes: a pass counts up to LEVELS_PER_PASS levels from one scan, and the next one reads only
    the points under inner cells of the last level so far, so that points in shallow leaves are never carried down.  Where there are several
    passes, the counts of each are read several times: ``materialize`` (a table in shared storage) keeps scans from multiplying.
    """
    out, rest, first = None, points, 0
    while True:
        last = min(first + LEVELS_PER_PASS - 1, config.max_depth)
        counts = cell_counts(rest, first, last)
        counts = counts if last == config.max_depth and not first else materialize(counts)
        inner = counts.filter((F.col("n_points") > config.max_points) & (F.col("level") < config.max_depth))
        up = inner.select((F.col("level") + 1).alias("_l"), *[F.col(f"n{a}").alias(f"i{a}") for a in AXES])
        on = [F.col("level") == F.col("_l"), *[F.call_function("shiftright", F.col(f"n{a}"), F.lit(1)) == F.col(f"i{a}") for a in AXES]]
        # the first level of a later pass holds only cells under inner ones
        here = counts.filter(F.col("level") > first).join(up, on, "left_semi").unionByName(counts.filter(F.col("level") == first))
        out = here if out is None else out.unionByName(here)
        if last == config.max_depth:
            return out
        inner = inner.filter(F.col("level") == last).select(*[F.col(f"n{a}").alias(f"i{a}") for a in AXES])
        on = [node_coordinate(F.col(c), last) == F.col(f"i{a}") for c, a in zip(LATTICE, AXES, strict=True)]
        rest, first = rest.join(inner, on, "left_semi"), last + 1


def nodes(points: DataFrame, config: TreeConfig, materialize: Materialize = lambda df: df) -> DataFrame:
    """(level, nx, ny, nz, n_points, is_inner): the root and all eight children of every inner node, empty ones included."""
    counts = materialize(node_counts(points, config, materialize))
    inner = counts.filter((F.col("n_points") > config.max_points) & (F.col("level") < config.max_depth))
    corner = F.explode(F.array(*[F.struct(*[F.lit(k >> b & 1).cast("long").alias(a) for a, b in zip(AXES, (2, 1, 0), strict=True)]) for k in range(8)])).alias("c")
    children = inner.select(F.col("level") + 1, *[f"n{a}" for a in AXES], corner).toDF("level", "nx", "ny", "nz", "c")
    children = children.select("level", *[(F.col(f"n{a}") * 2 + F.col(f"c.{a}")).alias(f"n{a}") for a in AXES], F.lit(0).cast("long").alias("n_points"))
    root = points.sparkSession.range(1).select(F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(f"n{a}") for a in AXES], F.lit(0).cast("long").alias("n_points"))
    # counts and the empty frame meet in one aggregation, without a join
    whole = counts.unionByName(children).unionByName(root).groupBy(*NODE).agg(F.sum("n_points").alias("n_points"))
    return whole.withColumn("is_inner", (F.col("n_points") > config.max_points) & (F.col("level") < config.max_depth))


def with_leaf_level(points: DataFrame, tree: DataFrame, config: TreeConfig) -> DataFrame:
    """Adds level, that of each point's leaf: the number of inner nodes on its path, found by bisection.

    A cell is inner only if all above it are, so about log2(max_depth) equi-joins with the inner nodes do, with one row per point each: no point is
    copied to every level, and Spark broadcasts the nodes where they are few.
    """
    inner = tree.filter("is_inner").select(F.col("level").alias("_l"), *[F.col(f"n{a}").alias(f"_{a}") for a in AXES], F.lit(True).alias("_in"))
    rows, step = points.withColumn("level", F.lit(0)), 1 << max(0, config.max_depth.bit_length() - 1)
    while step and config.max_depth:
        at = F.col("level") + (step - 1)
        rows = settled(rows, _at=at, **{f"_c{a}": node_coordinate(F.col(c), F.least(at, F.lit(config.max_depth))) for c, a in zip(LATTICE, AXES, strict=True)})
        rows = rows.join(inner, [F.col("_at") == F.col("_l"), *[F.col(f"_c{a}") == F.col(f"_{a}") for a in AXES]], "left")
        rows = rows.withColumn("level", F.col("level") + F.when(F.col("_in"), step).otherwise(0)).drop("_at", "_l", "_in", *[f"_{a}" for a in AXES], *[f"_c{a}" for a in AXES])
        step >>= 1
    return rows


def leaf_points(points: DataFrame, tree: DataFrame, config: TreeConfig, *keep: str) -> DataFrame:
    """Each point with its leaf."""
    rows = with_leaf_level(points.select("pid", *keep, *LATTICE), tree, config)
    return rows.select("pid", *keep, *LATTICE, "level", *[node_coordinate(F.col(c), F.col("level")).alias(f"n{a}") for c, a in zip(LATTICE, AXES, strict=True)])


def point_ancestors(points: DataFrame, tree: DataFrame, config: TreeConfig, *keep: str) -> DataFrame:
    """Each point with every inner node above it."""
    rows = with_leaf_level(points.select("pid", *keep, *LATTICE), tree, config).filter("level > 0")
    rows = rows.select("pid", *keep, *LATTICE, F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("level"))
    return rows.withColumns({f"n{a}": node_coordinate(F.col(c), F.col("level")) for c, a in zip(LATTICE, AXES, strict=True)})


def voxels(points: DataFrame, tree: DataFrame, config: TreeConfig, materialize: Materialize = lambda df: df) -> DataFrame:
    """(node, vx, vy, vz, first_pid, color): distinct grid cells of inner nodes, coloured by the point with the smallest pid.

    A point is counted once, in a cell of its leaf's parent; coarser cells are made from finer ones (the first of the firsts), a few levels at a
    time from the deepest up, so the rows shrink with the cells and no point is copied to every level.
    """
    g = [f"g{a}" for a in AXES]
    leaves = with_leaf_level(points.select("pid", "color", *LATTICE), tree, config).filter("level > 0").withColumn("level", F.col("level") - 1)
    cells = leaves.select("level", *[voxel_coordinate(F.col(c), F.col("level"), config.grid_bits).alias(x) for c, x in zip(LATTICE, g, strict=True)], "pid", "color")
    cells = cells.groupBy("level", *g).agg(F.min(F.struct("pid", "color")).alias("first"))
    cells = materialize(cells) if config.max_depth > VOXEL_LEVELS_PER_PASS else cells
    out, carried, high = None, None, config.max_depth - 1
    while high >= 0:
        low = max(0, high - VOXEL_LEVELS_PER_PASS + 1)
        here = cells.filter(F.col("level").between(low, high))
        here = here if carried is None else here.unionByName(carried)
        up = here.select(F.explode(F.sequence(F.lit(low), F.col("level"))).alias("to"), "level", *g, "first")
        up = up.select(F.col("to").alias("level"), *[F.call_function("shiftright", F.col(x), F.col("level") - F.col("to")).alias(x) for x in g], "first")
        up = up.groupBy("level", *g).agg(F.min("first").alias("first"))
        up = materialize(up) if low else up
        out = up if out is None else out.unionByName(up)
        carried = up.filter(F.col("level") == low).select((F.col("level") - 1).alias("level"), *[F.shiftright(x, 1).alias(x) for x in g], "first")
        high = low - 1
    if out is None:
        out = cells
    node = [F.shiftright(f"g{a}", config.grid_bits).alias(f"n{a}") for a in AXES]
    inside = [F.col(f"g{a}").bitwiseAND(F.lit(config.grid - 1)).alias(f"v{a}") for a in AXES]
    return out.select("level", *node, *inside, F.col("first.pid").alias("first_pid"), F.col("first.color").alias("color"))


def voxel_index(config: TreeConfig) -> F.Column:
    return F.col("vx") + F.col("vy") * config.grid + F.col("vz") * config.grid * config.grid


def voxel_centres(some: DataFrame, config: TreeConfig, cube: Cube) -> DataFrame:
    """Adds x, y, z of the voxels' centres."""
    size = F.lit(cube.size) / F.pow(F.lit(2.0), F.col("level"))
    low = {"x": cube.x, "y": cube.y, "z": cube.z}
    centre = {a: F.lit(low[a]) + F.col(f"n{a}") * size + size * (F.col(f"v{a}") + F.lit(0.5)) / F.lit(float(config.grid)) for a in AXES}
    return some.withColumns(centre)


def voxel_counts(some: DataFrame) -> DataFrame:
    return some.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_voxels"))


def with_voxel_counts(tree: DataFrame, some: DataFrame) -> DataFrame:
    """Adds n_voxels and n_stored (points that the node itself owns) to nodes."""
    counted = voxel_counts(some).select(*[F.col(c).alias(f"_{c}") for c in NODE], "n_voxels")
    out = tree.join(counted, [F.col(c) == F.col(f"_{c}") for c in NODE], "left").drop(*[f"_{c}" for c in NODE])
    return with_stored(out.withColumn("n_voxels", F.coalesce("n_voxels", F.lit(0))))


def with_stored(tree: DataFrame) -> DataFrame:
    """Adds n_stored, the points that a node itself owns."""
    return tree.withColumn("n_stored", F.when(F.col("is_inner"), 0).otherwise(F.col("n_points")))


def chunk_slots(leaves: DataFrame, config: TreeConfig) -> DataFrame:
    """Adds chunk and slot: the place of a point in its leaf, by pid.  A leaf holds max_points points at most (but at the deepest level)."""
    at = F.row_number().over(Window.partitionBy(*NODE).orderBy("pid")) - 1
    return leaves.withColumn("_at", at).withColumns({"chunk": F.floor(F.col("_at") / config.chunk), "slot": (F.col("_at") % config.chunk).cast("long")}).drop("_at")


def stats(counted: DataFrame, config: TreeConfig) -> DataFrame:
    """One row about nodes with n_voxels and n_stored."""
    leaf = ~F.col("is_inner")

    def chunks(n: str) -> F.Column:
        return F.floor((F.col(n) + (config.chunk - 1)) / config.chunk)

    def count(condition: F.Column) -> F.Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    return counted.agg(
        F.count(F.lit(1)).alias("n_nodes"), count(F.col("is_inner")).alias("n_inner"), count(leaf).alias("n_leaves"), count(leaf & (F.col("n_points") > 0)).alias("n_nonempty_leaves"),
        F.sum("n_stored").alias("n_points"), F.sum("n_voxels").alias("n_voxels"), F.sum(chunks("n_stored")).alias("n_point_chunks"), F.sum(chunks("n_voxels")).alias("n_voxel_chunks"),
    )


def samples(leaves: DataFrame, some_voxels: DataFrame, config: TreeConfig, cube: Cube) -> DataFrame:
    """Everything that can be drawn: (kind, node, x, y, z, color): the leaves' points (x, y, z, color needed) and the inner nodes' voxels."""
    points = leaves.select(F.lit("point").alias("kind"), *NODE, *AXES, "color")
    return points.unionByName(voxel_centres(some_voxels, config, cube).select(F.lit("voxel").alias("kind"), *NODE, *AXES, "color"))


def parents(tree: DataFrame) -> DataFrame:
    """(node, px_.., child): each node with its parent's coordinates and its place among the eight."""
    up = {f"parent_{a}": F.shiftright(f"n{a}", 1) for a in AXES}
    return tree.filter("level > 0").withColumns(up | {"child": child_index(*[F.col(f"n{a}") for a in AXES])})
