"""Nested sampling: each point is kept once, in the first node on its path with a free grid cell.

Which point takes a cell depends on the order; here it is the smallest pid.  A level's winners leave, the
others go on, so the levels follow each other: an aggregation and an anti-join each.  ``materialize`` cuts
the lineage between levels (a table in shared storage).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from octolith.config import TreeConfig
from octolith.functions.lattice import AXES, LATTICE, NODE, node_coordinate, voxel_coordinate


def nested_samples(points: DataFrame, tree: DataFrame, config: TreeConfig, materialize: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(pid, node): an inner node for winners, the leaf for the rest."""
    rest, out = points.select("pid", *LATTICE), None
    for level in range(config.max_depth + 1):
        here = tree.filter(F.col("level") == level)
        at = [node_coordinate(F.col(c), level).alias(f"n{a}") for c, a in zip(LATTICE, AXES, strict=True)]
        rows = rest.select("pid", *LATTICE, *at)
        known = here.select(*[F.col(c).alias(f"_{c}") for c in NODE[1:]], "is_inner")
        rows = rows.join(known, [F.col(c) == F.col(f"_{c}") for c in NODE[1:]]).drop(*[f"_{c}" for c in NODE[1:]])
        cells = [voxel_coordinate(F.col(c), level, config.grid_bits).alias(f"g{a}") for c, a in zip(LATTICE, AXES, strict=True)]
        first = rows.filter("is_inner").select("pid", *cells).groupBy(*[f"g{a}" for a in AXES]).agg(F.min("pid").alias("_pid"))
        won = rows.join(first.select("_pid"), F.col("pid") == F.col("_pid"), "left_semi") if level < config.max_depth else rows.filter(F.lit(False))
        taken = won.unionByName(rows.filter("NOT is_inner")).select("pid", F.lit(level).alias("level"), *NODE[1:])
        out = taken if out is None else out.unionByName(taken)
        if level < config.max_depth:
            rest = materialize(rows.filter("is_inner").join(first.select("_pid"), F.col("pid") == F.col("_pid"), "left_anti").select("pid", *LATTICE))
    return out
