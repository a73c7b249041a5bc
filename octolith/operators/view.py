"""View-dependent selection of nodes.  A view is literals in the plan: no join with parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.config import Cube, View
from octolith.functions.camera import apply, box_in_frustum, frustum_planes
from octolith.functions.lattice import AXES, NODE, settled


def with_boxes(nodes: DataFrame, cube: Cube) -> DataFrame:
    """Adds min_x.., max_x.. (and the edge, node_size)."""
    low = {"x": cube.x, "y": cube.y, "z": cube.z}
    nodes = settled(nodes, node_size=F.lit(cube.size) / F.pow(F.lit(2.0), F.col("level")))
    boxes = {f"min_{a}": F.lit(low[a]) + F.col(f"n{a}") * F.col("node_size") for a in AXES} | {f"max_{a}": F.lit(low[a]) + (F.col(f"n{a}") + 1) * F.col("node_size") for a in AXES}
    return settled(nodes, **boxes)


def node_centre(axis: str) -> Column:
    return (F.col(f"min_{axis}") + F.col(f"max_{axis}")) / 2


def in_frustum(view: View) -> Column:
    planes = frustum_planes(view.update_transform)
    return box_in_frustum(planes, [F.col(f"min_{a}") for a in AXES], [F.col(f"max_{a}") for a in AXES])


def with_extent(rows: DataFrame, view: View) -> DataFrame:
    """Adds _dx and _dy: width and height in pixels of the box around a node's eight projected corners.

    Corners behind the eye project as they come; on the eye's plane they count as missing.
    """
    clip = {}
    for k in range(8):
        corner = [F.col(f"{'max' if k >> b & 1 else 'min'}_{a}") for a, b in zip(AXES, (2, 1, 0), strict=True)]
        x, y, _, w = apply(view.update_transform, *corner)
        clip |= {f"_x{k}": x, f"_y{k}": y, f"_w{k}": F.nullif(w, F.lit(0.0))}
    names = rows.columns
    rows = settled(rows, **clip)
    screen = {}
    for k in range(8):
        screen[f"_x{k}"] = (F.col(f"_x{k}") / F.col(f"_w{k}") * F.lit(0.5) + F.lit(0.5)) * F.lit(float(view.width))
        screen[f"_y{k}"] = (F.col(f"_y{k}") / F.col(f"_w{k}") * F.lit(0.5) + F.lit(0.5)) * F.lit(float(view.height))
    rows = settled(rows, **screen)
    extent = {f"_d{a}": F.coalesce(F.greatest(*[f"_{a}{k}" for k in range(8)]) - F.least(*[f"_{a}{k}" for k in range(8)]), F.lit(float("inf"))) for a in "xy"}
    return settled(rows, **extent).select(*names, "_dx", "_dy")


def with_visibility(nodes: DataFrame, view: View, cube: Cube) -> DataFrame:
    """Adds intersects, is_large and visible to nodes.  An inner node has points below it, so it has voxels: they need not be made to know."""
    out = with_extent(with_boxes(nodes, cube), view).withColumn("intersects", in_frustum(view))
    large = (F.col("_dx") > 2.0 * view.min_node_size) | (F.col("_dy") > 2.0 * view.min_node_size)
    samples = F.col("is_inner") | (F.col("n_points") > 0)
    return out.withColumns({"is_large": large, "visible": F.col("intersects") & samples})


def _listed(rows: DataFrame) -> DataFrame:
    """(node, kind, n_stored[, n_voxels])."""
    counts = [c for c in ("n_voxels",) if c in rows.columns]
    return rows.select(*NODE, kind().alias("kind"), F.when(F.col("is_inner"), 0).otherwise(F.col("n_points")).alias("n_stored"), *counts)


def kind() -> Column:
    return F.when(F.col("is_inner"), "inner").otherwise("leaf")


def visible_disjoint(nodes: DataFrame, view: View, cube: Cube, with_root: bool = False) -> DataFrame:
    """(node, kind, n_stored, n_voxels if the nodes have it): small visible children of large inner nodes, and large visible leaves.

    ``with_root`` also takes a root that is not large, of which otherwise nothing is drawn.
    """
    rows = with_visibility(nodes, view, cube).select(*NODE, "is_inner", "n_points", *[c for c in ("n_voxels",) if c in nodes.columns], "is_large", "visible")
    parents = rows.filter("is_large AND is_inner").select((F.col("level") + 1).alias("_l"), *[F.col(f"n{a}").alias(f"_{a}") for a in AXES])
    small = rows.filter("NOT is_large AND visible AND level > 0")
    on = [F.col("level") == F.col("_l"), *[F.shiftright(f"n{a}", 1) == F.col(f"_{a}") for a in AXES]]
    out = small.join(parents, on, "left_semi").unionByName(rows.filter("is_large AND visible AND NOT is_inner"))
    if with_root:
        out = out.unionByName(rows.filter("level = 0 AND NOT is_large AND visible"))
    return _listed(out)


def visible_additive(nodes: DataFrame, view: View, cube: Cube) -> DataFrame:
    """Every node in view that is at least min_node_size wide and high."""
    rows = with_visibility(nodes, view, cube)
    keep = F.col("visible") & ~((F.col("_dx") < view.min_node_size) | (F.col("_dy") < view.min_node_size))
    return _listed(rows.filter(keep))


def visibility_stats(visible: DataFrame) -> DataFrame:
    leaf = F.col("kind") == "leaf"
    inner = ~leaf & (F.col("n_voxels") > 0)

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0).cast("long"))

    return visible.agg(
        F.count(F.lit(1)).alias("n_visible"), total(leaf.cast("long")).alias("n_leaves"), total(inner.cast("long")).alias("n_inner"),
        total(F.when(leaf, F.col("n_stored"))).alias("n_points"), total(F.when(inner, F.col("n_voxels"))).alias("n_voxels"),
    )


def of_nodes(samples: DataFrame, visible: DataFrame) -> DataFrame:
    """The samples of visible nodes."""
    keys = visible.select(*[F.col(c).alias(f"_{c}") for c in NODE])
    return samples.join(keys, [F.col(c) == F.col(f"_{c}") for c in NODE], "left_semi")


def cull_by_children(voxels: DataFrame, visible: DataFrame, grid: int) -> DataFrame:
    """Voxels whose octant has no visible child node: where nodes are drawn on top of their parents."""
    keys = visible.filter("level > 0").select((F.col("level") - 1).alias("_l"), *[F.col(f"n{a}").alias(f"_{a}") for a in AXES])
    child = [(F.col(f"n{a}") * 2 + (F.col(f"v{a}") >= grid // 2).cast("long")) == F.col(f"_{a}") for a in AXES]
    return voxels.join(keys, [F.col("level") == F.col("_l"), *child], "left_anti")


EDGES = [(a, b) for face in (0, 1) for a, b in (((0, 0, face), (1, 0, face)), ((1, 0, face), (1, 1, face)), ((1, 1, face), (0, 1, face)), ((0, 1, face), (0, 0, face)))] + [((x, y, 0), (x, y, 1)) for x, y in ((1, 0), (1, 1), (0, 1), (0, 0))]


def box_edges(nodes: DataFrame, cube: Cube) -> DataFrame:
    """Twelve edges of each node's box: (node, edge, x0, y0, z0, x1, y1, z1)."""
    ends = [F.struct(F.lit(k).alias("edge"), *[F.col(f"{'max' if p[i] else 'min'}_{a}").alias(f"{a}{e}") for e, p in enumerate(edge) for i, a in enumerate(AXES)]) for k, edge in enumerate(EDGES)]
    return with_boxes(nodes, cube).select(*NODE, F.explode(F.array(*ends)).alias("x")).select(*NODE, "x.*")
