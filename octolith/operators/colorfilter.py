"""Bottom-up colour filter: a voxel takes the mean colour of the samples of the node's children in it.

Samples of a child are its points if it is a leaf, its (already filtered) voxels if it is inner; each
counts once.  The work goes level by level, deepest first: one aggregation per level over rows that shrink
towards the root.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.config import TreeConfig
from octolith.functions.colors import channel, pack_color
from octolith.functions.lattice import AXES, LATTICE, NODE, voxel_coordinate

GLOBAL = tuple(f"g{a}" for a in AXES)


def _mean(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy(*GLOBAL).agg(F.count(F.lit(1)).alias("n"), *[F.sum(channel(F.col("color"), k)).alias(f"s{k}") for k in range(3)])
    return sums.select(*GLOBAL, pack_color(*[F.floor(F.col(f"s{k}") / F.col("n")) for k in range(3)]).alias("color"))


def filter_level(leaves: DataFrame, finer: DataFrame | None, level: int, config: TreeConfig) -> DataFrame:
    """(gx, gy, gz, color) of one level, from leaf points (with lattice and color) and the voxels of the level below."""
    here = leaves.filter(F.col("level") == level + 1).select(*[voxel_coordinate(F.col(c), level, config.grid_bits).alias(g) for c, g in zip(LATTICE, GLOBAL, strict=True)], "color")
    if finer is not None:
        here = here.unionByName(finer.select(*[F.shiftright(g, 1).alias(g) for g in GLOBAL], "color"))
    return _mean(here)


def filter_colors(leaves: DataFrame, config: TreeConfig, deepest: int | None = None, materialize: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Voxels of all inner nodes with filtered colours: (node, vx, vy, vz, color).  ``materialize`` cuts the plan between levels."""
    out, finer = None, None
    for level in range((config.max_depth if deepest is None else deepest) - 1, -1, -1):
        finer = materialize(filter_level(leaves, finer, level, config))
        node = [F.shiftright(g, config.grid_bits).alias(f"n{a}") for g, a in zip(GLOBAL, AXES, strict=True)]
        inside = [F.col(g).bitwiseAND(F.lit(config.grid - 1)).alias(f"v{a}") for g, a in zip(GLOBAL, AXES, strict=True)]
        rows = finer.select(F.lit(level).alias("level"), *node, *inside, "color")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("a tree of depth 0 has no voxels")
    return out


def unaccounted(filtered: DataFrame, voxels: DataFrame) -> DataFrame:
    """Voxels that only one of the two tables has; empty if the filter kept every one."""
    keys = [*NODE, "vx", "vy", "vz"]
    a, b = filtered.select(*keys), voxels.select(*keys)
    return a.exceptAll(b).unionByName(b.exceptAll(a))
