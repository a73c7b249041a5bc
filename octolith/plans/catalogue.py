"""One query per operator over the test tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.config import TreeConfig, View
from octolith.functions import camera, colors, lattice, quantize, scalars
from octolith.functions.lattice import AXES, LATTICE, NODE
from octolith.operators import colorfilter, nested, octree, raster, view
from octolith.operators import spatial_index as si
from octolith.plans.adaptors import CUBE, EMBEDDINGS, EVENTS, LINES, embedding_points, event_points, line_points
from octolith.sources import files, las
from octolith.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SMALL = TreeConfig(max_points=50, max_depth=5, grid=16, chunk=10)
WIDE = TreeConfig(max_points=500, max_depth=8, grid=16)
#: Entries are powers of two, so that every product is exact.
FLAT = View(((2.0**-19, 0, 0, -1.0), (0, 2.0**-19, 0, -1.0), (0, 0, 2.0**-19, -1.0), (0, 0, 0, 1.0)), 64, 64, 4.0)
DEEP = View(((2.0, 0, 0, -(2.0**20)), (0, 2.0, 0, -(2.0**20)), (0, 0, 1.0, 0), (0, 0, 1.0, 2.0**20)), 64, 64, 4.0)
GRID = si.Grid(0.0, 0.0, 65536.0, 4)
RECTANGLE = ((100_000.0, 50_000.0), (400_000.0, 300_000.0))
CIRCLE = (100_000.0, 40_000.0, 60_000.0)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# SQL fragments -----------------------------------------------------------------------------------


def _tree(points: str, c: TreeConfig) -> str:
    return f"""WITH {points},
k AS (SELECT pts.*, l::INTEGER AS level, px >> (28 - l) AS nx, py >> (28 - l) AS ny, pz >> (28 - l) AS nz FROM pts, range(0, {c.max_depth + 1}) AS t(l)),
counts AS MATERIALIZED (SELECT level, nx, ny, nz, count(*) AS n FROM k GROUP BY ALL),
inn AS (SELECT * FROM counts WHERE n > {c.max_points} AND level < {c.max_depth}),
slots AS (SELECT (level + 1)::INTEGER AS level, nx * 2 + (c >> 2) AS nx, ny * 2 + (c >> 1) % 2 AS ny, nz * 2 + c % 2 AS nz FROM (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS c FROM inn)
          UNION ALL SELECT 0, 0, 0, 0),
tree AS (SELECT level, nx, ny, nz, sum(n)::BIGINT AS n_points, sum(n) > {c.max_points} AND level < {c.max_depth} AS is_inner
         FROM (SELECT *, 0 AS n, 1 AS slot FROM slots UNION ALL SELECT *, 0 FROM counts) GROUP BY level, nx, ny, nz HAVING max(slot) = 1),
leaves AS (SELECT k.* FROM k JOIN tree USING (level, nx, ny, nz) WHERE NOT is_inner),
anc AS (SELECT k.* FROM k JOIN tree USING (level, nx, ny, nz) WHERE is_inner),
vox AS (SELECT level, nx, ny, nz, (px >> (28 - {c.grid_bits} - level)) % {c.grid} AS vx, (py >> (28 - {c.grid_bits} - level)) % {c.grid} AS vy, (pz >> (28 - {c.grid_bits} - level)) % {c.grid} AS vz,
               min(pid) AS first_pid, arg_min(color, pid) AS color FROM anc GROUP BY ALL),
full_tree AS (SELECT tree.*, coalesce(v, 0) AS n_voxels, CASE WHEN is_inner THEN 0 ELSE n_points END AS n_stored
              FROM tree LEFT JOIN (SELECT level, nx, ny, nz, count(*) AS v FROM vox GROUP BY ALL) USING (level, nx, ny, nz))
"""


def _apply(m, x: str, y: str, z: str) -> list[str]:
    return [f"({r[0]!r}::DOUBLE * {x} + {r[1]!r}::DOUBLE * {y} + {r[2]!r}::DOUBLE * {z} + {r[3]!r}::DOUBLE)" for r in ([float(v) for v in row] for row in m)]


def _visible(v: View) -> str:
    """Adds boxes, tests and flags: table flags."""
    x, y, _, w = _apply(v.transform, "cx", "cy", "cz")
    planes = " AND ".join(
        f"{a!r}::DOUBLE * {'x1' if a > 0 else 'x0'} + {b!r}::DOUBLE * {'y1' if b > 0 else 'y0'} + {c!r}::DOUBLE * {'z1' if c > 0 else 'z0'} + {d!r}::DOUBLE >= 0"
        for a, b, c, d in camera.frustum_planes(v.transform)
        if a or b or c
    )
    return f""", boxes AS (SELECT *, nx * s AS x0, (nx + 1) * s AS x1, ny * s AS y0, (ny + 1) * s AS y1, nz * s AS z0, (nz + 1) * s AS z1
    FROM (SELECT *, 1048576.0::DOUBLE / pow(2.0::DOUBLE, level) AS s FROM full_tree)),
corners AS (SELECT level, nx, ny, nz, CASE WHEN a = 1 THEN x1 ELSE x0 END AS cx, CASE WHEN b = 1 THEN y1 ELSE y0 END AS cy, CASE WHEN d = 1 THEN z1 ELSE z0 END AS cz
    FROM boxes, range(0, 2) AS x(a), range(0, 2) AS y(b), range(0, 2) AS z(d)),
extent AS (SELECT level, nx, ny, nz, max(sx) - min(sx) AS dx, max(sy) - min(sy) AS dy
    FROM (SELECT *, ({x} / {w} * 0.5::DOUBLE + 0.5::DOUBLE) * {float(v.width)}::DOUBLE AS sx, ({y} / {w} * 0.5::DOUBLE + 0.5::DOUBLE) * {float(v.height)}::DOUBLE AS sy FROM corners) GROUP BY ALL),
flags AS (SELECT *, {planes} AS intersects, dx > {2 * v.min_node_size} OR dy > {2 * v.min_node_size} AS is_large, {planes} AND (n_stored > 0 OR n_voxels > 0) AS visible,
    CASE WHEN n_stored > 0 THEN 'leaf' ELSE 'inner' END AS kind FROM boxes JOIN extent USING (level, nx, ny, nz)),
vis AS (SELECT c.* FROM flags c JOIN flags p ON p.level = c.level - 1 AND p.nx = c.nx // 2 AND p.ny = c.ny // 2 AND p.nz = c.nz // 2
    WHERE p.is_large AND p.is_inner AND NOT c.is_large AND c.visible UNION ALL SELECT * FROM flags WHERE is_large AND visible AND NOT is_inner)
"""


def _frags(source: str, v: View) -> str:
    x, y, _, w = _apply(v.transform, "x", "y", "z")
    return f""", proj AS (SELECT *, (({x} / {w}) * 0.5::DOUBLE + 0.5::DOUBLE) * {float(v.width)}::DOUBLE AS sx, (({y} / {w}) * 0.5::DOUBLE + 0.5::DOUBLE) * {float(v.height)}::DOUBLE AS sy, {w} AS depth FROM {source}),
frags AS (SELECT least(trunc(sx)::INTEGER + ox, {v.width - 1})::INTEGER AS px, least(trunc(sy)::INTEGER + oy, {v.height - 1})::INTEGER AS py, depth, color
    FROM (SELECT sx, sy, depth, color FROM proj WHERE depth > 0 AND sx >= 2 AND sx < {v.width - 2} AND sy >= 2 AND sy < {v.height - 2}), range(0, {v.point_size}) AS a(ox), range(0, {v.point_size}) AS b(oy))
"""


_NEAREST = "SELECT px, py, f.depth AS depth, f.color AS color FROM (SELECT px, py, min({'depth': depth, 'color': color}) AS f FROM frags GROUP BY ALL)"
_CELL = f"(floor(x / {GRID.cell}::DOUBLE)::BIGINT)", f"(floor(y / {GRID.cell}::DOUBLE)::BIGINT)"
_PATH = " + ".join(f"(({c} >> {k}) & 1) * {1 << (2 * k + odd)}" for k in range(GRID.levels) for odd, c in enumerate(_CELL))
_INDEX = f"{si.level_offset(GRID.levels)} + {_PATH}"
_CELLS = f"WITH {EVENTS}, cells AS (SELECT pid, x, y, {_INDEX} AS cell FROM pts)"
_RUNS = _CELLS + """, runs AS (SELECT cell, min(pid) AS start, max(pid) AS "end", count(*) AS "full" FROM (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY pid) AS island FROM
  (SELECT cell, pid, CASE WHEN pid - lag(pid) OVER (PARTITION BY cell ORDER BY pid) <= 100 THEN 0 ELSE 1 END AS new FROM cells)) GROUP BY cell, island)"""


# lattice and tree ----------------------------------------------------------------------------------


def _events_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = event_points(spark, d)
    return points, stored(octree.nodes(points, SMALL, stored), "nodes")


def _lines_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = line_points(spark, d)
    return points, stored(octree.nodes(points, WIDE, stored), "nodes")


def _with_voxels(points: DataFrame, tree: DataFrame, config: TreeConfig) -> tuple[DataFrame, DataFrame]:
    some = stored(octree.voxels(points, tree, config, stored), "voxels")
    return some, stored(octree.with_voxel_counts(tree, some), "nodes")


@query("lattice_project", f"WITH {EVENTS} SELECT pid, px, py, pz, (px >> 25)::BIGINT AS n3, ((px >> 25) & 1) * 4 + ((py >> 25) & 1) * 2 + ((pz >> 25) & 1) AS child, (px >> 18) % 128 AS v3 FROM pts")
def _(spark, d):
    rows = lattice.with_lattice(event_points(spark, d).select("pid", *AXES), CUBE)
    node = [lattice.node_coordinate(F.col(c), 3) for c in LATTICE]
    voxel = lattice.voxel_coordinate(F.col("px"), 3, 7).bitwiseAND(F.lit(127))
    return rows.select("pid", *LATTICE, node[0].alias("n3"), lattice.child_index(*node).alias("child"), voxel.alias("v3"))


_BITS = " + ".join(f"((({c} >> {k}) & 1) << {3 * k + s})" for k in range(20) for s, c in ((2, "(px // 256)"), (1, "(py // 256)"), (0, "(pz // 256)")))


@query("morton_code", f"WITH {EVENTS} SELECT pid, {_BITS} AS code, 'r' || ((px >> 27) * 4 + (py >> 27) * 2 + (pz >> 27))::VARCHAR AS name FROM pts")
def _(spark, d):
    p = event_points(spark, d)
    code = lattice.morton(*[F.shiftright(c, 8) for c in LATTICE])
    one = lattice.morton(*[F.shiftright(c, 27) for c in LATTICE])
    return p.select("pid", code.alias("code"), lattice.node_name(F.lit(1), one).alias("name"))


@query("node_counts", _tree(LINES, WIDE) + "SELECT level, nx, ny, nz, n AS n_points FROM counts c WHERE level = 0 OR EXISTS (SELECT 1 FROM inn i WHERE i.level = c.level - 1 AND i.nx = c.nx // 2 AND i.ny = c.ny // 2 AND i.nz = c.nz // 2)")
def _(spark, d):
    return octree.node_counts(line_points(spark, d), WIDE)


@query("cell_counts", f"WITH {LINES} SELECT l::INTEGER AS level, px >> (28 - l) AS nx, py >> (28 - l) AS ny, pz >> (28 - l) AS nz, count(*) AS n_points FROM pts, range(0, 6) AS t(l) GROUP BY ALL")
def _(spark, d):
    return octree.cell_counts(line_points(spark, d), 0, 5)


@query("octree_nodes", _tree(LINES, WIDE) + "SELECT * FROM tree")
def _(spark, d):
    return octree.nodes(line_points(spark, d), WIDE, stored)


@query("leaf_assignment", _tree(EVENTS, SMALL) + "SELECT pid, level, nx, ny, nz FROM leaves")
def _(spark, d):
    points, tree = _events_tree(spark, d)
    return octree.leaf_points(points, tree, SMALL).select("pid", *NODE)


@query("leaf_sizes", _tree(LINES, WIDE) + "SELECT level, nx, ny, nz, count(*) AS n_points FROM leaves GROUP BY ALL")
def _(spark, d):
    points, tree = _lines_tree(spark, d)
    return octree.leaf_points(points, tree, WIDE).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_points"))


@query("point_ancestors", _tree(EVENTS, SMALL) + "SELECT pid, level, nx, ny, nz FROM anc")
def _(spark, d):
    points, tree = _events_tree(spark, d)
    return octree.point_ancestors(points, tree, SMALL).select("pid", *NODE)


@query("voxels_first_color", _tree(EVENTS, SMALL) + "SELECT * FROM vox")
def _(spark, d):
    points, tree = _events_tree(spark, d)
    return octree.voxels(points, tree, SMALL, stored)


@query("voxel_counts", _tree(LINES, WIDE) + "SELECT level, nx, ny, nz, count(*) AS n_voxels FROM vox GROUP BY ALL")
def _(spark, d):
    points, tree = _lines_tree(spark, d)
    return octree.voxel_counts(octree.voxels(points, tree, WIDE, stored))


@query(
    "voxel_centres",
    _tree(EVENTS, SMALL) + "SELECT level, nx, ny, nz, vx, vy, vz, vx + vy * 16 + vz * 256 AS idx, nx * s + s * (vx + 0.5::DOUBLE) / 16 AS x, ny * s + s * (vy + 0.5::DOUBLE) / 16 AS y, nz * s + s * (vz + 0.5::DOUBLE) / 16 AS z FROM (SELECT *, 1048576.0::DOUBLE / pow(2.0::DOUBLE, level) AS s FROM vox)",
)
def _(spark, d):
    points, tree = _events_tree(spark, d)
    some = octree.voxel_centres(octree.voxels(points, tree, SMALL, stored), SMALL, CUBE)
    return some.select(*NODE, "vx", "vy", "vz", octree.voxel_index(SMALL).alias("idx"), *AXES)


_STATS = """SELECT count(*) AS n_nodes, sum(is_inner::BIGINT)::BIGINT AS n_inner, sum((NOT is_inner)::BIGINT)::BIGINT AS n_leaves, sum((NOT is_inner AND n_points > 0)::BIGINT)::BIGINT AS n_nonempty_leaves,
sum(n_stored)::BIGINT AS n_points, sum(n_voxels)::BIGINT AS n_voxels, sum((n_stored + 999) // 1000)::BIGINT AS n_point_chunks, sum((n_voxels + 999) // 1000)::BIGINT AS n_voxel_chunks FROM full_tree"""


@query("octree_stats", _tree(LINES, WIDE) + _STATS)
def _(spark, d):
    points, tree = _lines_tree(spark, d)
    return octree.stats(_with_voxels(points, tree, WIDE)[1], WIDE)


@query("chunk_slots", _tree(EVENTS, SMALL) + "SELECT pid, (place // 10)::BIGINT AS chunk, (place % 10)::BIGINT AS slot FROM (SELECT pid, row_number() OVER (PARTITION BY level, nx, ny, nz ORDER BY pid) - 1 AS place FROM leaves)")
def _(spark, d):
    points, tree = _events_tree(spark, d)
    return octree.chunk_slots(octree.leaf_points(points, tree, SMALL), SMALL).select("pid", "chunk", "slot")


_SAMPLES = """, samples AS (SELECT 'point' AS kind, level, nx, ny, nz, x, y, z, color FROM leaves UNION ALL
SELECT 'voxel', level, nx, ny, nz, nx * s + s * (vx + 0.5::DOUBLE) / 16, ny * s + s * (vy + 0.5::DOUBLE) / 16, nz * s + s * (vz + 0.5::DOUBLE) / 16, color FROM (SELECT *, 1048576.0::DOUBLE / pow(2.0::DOUBLE, level) AS s FROM vox))
"""


def _samples(points: DataFrame, tree: DataFrame, some: DataFrame) -> DataFrame:
    return octree.samples(octree.leaf_points(points, tree, SMALL, *AXES, "color"), some, SMALL, CUBE)


@query("drawable_samples", _tree(EVENTS, SMALL) + _SAMPLES + "SELECT * FROM samples")
def _(spark, d):
    points, tree = _events_tree(spark, d)
    return _samples(points, tree, octree.voxels(points, tree, SMALL, stored))


@query("parent_child", _tree(LINES, WIDE) + "SELECT level, nx, ny, nz, nx // 2 AS parent_x, ny // 2 AS parent_y, nz // 2 AS parent_z, (nx % 2) * 4 + (ny % 2) * 2 + nz % 2 AS child FROM tree WHERE level > 0")
def _(spark, d):
    return octree.parents(_lines_tree(spark, d)[1]).select(*NODE, "parent_x", "parent_y", "parent_z", "child")


# views -----------------------------------------------------------------------------------------------


@query("node_frustum", _tree(LINES, WIDE) + _visible(DEEP) + "SELECT level, nx, ny, nz, x0 AS min_x, z1 AS max_z, intersects FROM flags")
def _(spark, d):
    rows = view.with_visibility(_lines_tree(spark, d)[1], DEEP, CUBE)
    return rows.select(*NODE, "min_x", "max_z", "intersects")


@query("node_screen_size", _tree(LINES, WIDE) + _visible(DEEP) + "SELECT level, nx, ny, nz, is_large FROM flags")
def _(spark, d):
    return view.with_visibility(_lines_tree(spark, d)[1], DEEP, CUBE).select(*NODE, "is_large")


@query("visible_nodes_disjunct", _tree(LINES, WIDE) + _visible(DEEP) + "SELECT level, nx, ny, nz, kind FROM vis")
def _(spark, d):
    return view.visible_disjoint(_lines_tree(spark, d)[1], DEEP, CUBE).select(*NODE, "kind")


@query("visible_nodes_additive", _tree(LINES, WIDE) + _visible(DEEP) + "SELECT level, nx, ny, nz FROM flags WHERE visible AND NOT (dx < 4 OR dy < 4)")
def _(spark, d):
    return view.visible_additive(_lines_tree(spark, d)[1], DEEP, CUBE).select(*NODE)


@query(
    "visibility_stats",
    _tree(LINES, WIDE) + _visible(DEEP) + "SELECT count(*) AS n_visible, sum((kind = 'leaf')::BIGINT)::BIGINT AS n_leaves, sum((kind = 'inner')::BIGINT)::BIGINT AS n_inner, sum(CASE WHEN kind = 'leaf' THEN n_stored ELSE 0 END)::BIGINT AS n_points, sum(CASE WHEN kind = 'inner' THEN n_voxels ELSE 0 END)::BIGINT AS n_voxels FROM vis",
)
def _(spark, d):
    points, tree = _lines_tree(spark, d)
    return view.visibility_stats(view.visible_disjoint(_with_voxels(points, tree, WIDE)[1], DEEP, CUBE))


@query(
    "voxel_child_cull",
    _tree(EVENTS, SMALL) + _visible(DEEP) + "SELECT level, nx, ny, nz, vx, vy, vz FROM vox v WHERE NOT EXISTS (SELECT 1 FROM flags f WHERE f.visible AND NOT (dx < 4 OR dy < 4) AND f.level = v.level + 1 AND f.nx = v.nx * 2 + v.vx // 8 AND f.ny = v.ny * 2 + v.vy // 8 AND f.nz = v.nz * 2 + v.vz // 8)",
)
def _(spark, d):
    points, tree = _events_tree(spark, d)
    some, counted = _with_voxels(points, tree, SMALL)
    return view.cull_by_children(some, view.visible_additive(counted, DEEP, CUBE), SMALL.grid).select(*NODE, "vx", "vy", "vz")


def _edge_sql() -> str:
    """Rows of edge number and six digits: which corner of the box each end is."""
    return ", ".join(f"({k}, {''.join(map(str, a + b))!r})" for k, (a, b) in enumerate(view.EDGES))


_EDGES = ", boxes AS (SELECT *, 1048576.0::DOUBLE / pow(2.0::DOUBLE, level) AS s FROM tree), edges(edge, c) AS (VALUES " + _edge_sql() + ")"
_ENDS = ", ".join(f"(n{a} + substr(c, {3 * e + i + 1}, 1)::BIGINT) * s AS {a}{e}" for e in (0, 1) for i, a in enumerate(AXES))


@query("node_box_edges", _tree(LINES, WIDE) + _EDGES + " SELECT level, nx, ny, nz, edge, " + _ENDS + " FROM boxes, edges")
def _(spark, d):
    return view.box_edges(_lines_tree(spark, d)[1], CUBE)


# images ------------------------------------------------------------------------------------------------


@query("image_nearest", f"WITH {EVENTS}" + _frags("pts", DEEP) + _NEAREST)
def _(spark, d):
    return raster.nearest(raster.fragments(event_points(spark, d), DEEP))


BIG = View(DEEP.transform, 64, 64, 4.0, point_size=2)


@query("image_splats", f"WITH {EVENTS}" + _frags("pts", BIG) + _NEAREST)
def _(spark, d):
    return raster.nearest(raster.fragments(event_points(spark, d), BIG))


@query("image_orthographic", f"WITH {EVENTS}" + _frags("pts", FLAT) + _NEAREST)
def _(spark, d):
    return raster.nearest(raster.fragments(event_points(spark, d), FLAT))


@query("image_min_depth", f"WITH {EVENTS}" + _frags("pts", DEEP) + "SELECT px, py, min(depth) AS depth FROM frags GROUP BY ALL")
def _(spark, d):
    return raster.min_depth(raster.fragments(event_points(spark, d), DEEP))


_MEAN = "sum((color >> {s}) & 255) // count(*)"
_HQS = f"""SELECT f.px, f.py, ({_MEAN.format(s=0)} + {_MEAN.format(s=8)} * 256 + {_MEAN.format(s=16)} * 65536 + 4278190080)::BIGINT AS color
FROM frags f JOIN (SELECT px, py, min(depth) AS m FROM frags GROUP BY ALL) USING (px, py) WHERE depth < m * 1.01::DOUBLE GROUP BY ALL"""


@query("image_hqs", f"WITH {EVENTS}" + _frags("pts", DEEP) + _HQS)
def _(spark, d):
    return raster.blended(raster.fragments(event_points(spark, d), DEEP)).select("px", "py", "color")


@query("image_of_view", _tree(EVENTS, SMALL) + _SAMPLES + _visible(DEEP) + ", shown AS (SELECT samples.* FROM samples SEMI JOIN vis USING (level, nx, ny, nz))" + _frags("shown", DEEP) + _NEAREST)
def _(spark, d):
    points, tree = _events_tree(spark, d)
    some, counted = _with_voxels(points, tree, SMALL)
    shown = view.of_nodes(_samples(points, tree, some), view.visible_disjoint(counted, DEEP, CUBE))
    return raster.nearest(raster.fragments(shown, DEEP))


@query("image_clear", "SELECT (i % 64)::INTEGER AS px, (i // 64)::INTEGER AS py, 3351057::BIGINT AS color FROM range(0, 4096) AS t(i)")
def _(spark, d):
    return raster.clear(spark, DEEP).select("px", "py", "color")


def _edl_sql() -> str:
    w, last = DEEP.width, DEEP.width * DEEP.height - 1
    shade = f"exp(-(sum(CASE WHEN a.own = b.own THEN 0.0::DOUBLE ELSE greatest(a.own - b.own, 0.0::DOUBLE) END) / {raster.EDL_NORM}::DOUBLE) * 300.0::DOUBLE * {raster.EDL_STRENGTH}::DOUBLE)"
    channels = [f"trunc(shade * ((color >> {s}) & 255))::BIGINT" for s in (0, 8, 16)]
    return f""", near AS ({_NEAREST}),
image AS (SELECT i AS spot, coalesce(log2(depth), 'inf'::DOUBLE) AS own, coalesce(color, {colors.BACKGROUND}) AS color FROM range(0, {last + 1}) AS t(i) LEFT JOIN near ON px + py * {w} = i),
shaded AS (SELECT a.spot AS spot, any_value(a.color) AS color, {shade} AS shade
    FROM (SELECT *, greatest(0, least({last}, spot + unnest([1, -1, {w}, -{w}]))) AS other FROM image) a JOIN image b ON a.other = b.spot GROUP BY a.spot)
SELECT (spot % {w})::INTEGER AS px, (spot // {w})::INTEGER AS py, {channels[0]} + {channels[1]} * 256 + {channels[2]} * 65536 + 4278190080 AS color FROM shaded"""


@query("image_edl", f"WITH {EVENTS}" + _frags("pts", DEEP) + _edl_sql())
def _(spark, d):
    return raster.shaded(raster.filled(raster.nearest(raster.fragments(event_points(spark, d), DEEP)), DEEP), DEEP)


def _lines_sql(v: View) -> str:
    """Lines (x0, .., z1) of table segs: clipped, projected and walked in steps; their fragments."""
    planes = [p for p in camera.frustum_planes(v.transform) if any(p[:3])]
    at = lambda p, q, n: " + ".join(f"{x!r}::DOUBLE * {q}{a}" for x, a in zip(n, AXES, strict=True))

    def clipped(p: str, sign: str) -> str:
        inside = " AND ".join(f"{at(0, p, (a, b, c))} + {k!r}::DOUBLE >= 0" for a, b, c, k in planes)
        hits = []
        for a, b, c, k in planes:
            slope, away = f"({at(0, f'{sign}d', (a, b, c))})", f"({at(0, p, (a, b, c))} + {k!r}::DOUBLE)"
            hits.append(f"CASE WHEN {slope} > 0 AND -{away} / {slope} >= 0 THEN -{away} / {slope} ELSE 0.0::DOUBLE END")
        return f"CASE WHEN {inside} THEN 0.0::DOUBLE ELSE greatest({', '.join(hits)}, 0.0::DOUBLE) END"

    def projected(p: str) -> str:
        x, y, _, w = _apply(v.transform, f"{p}x", f"{p}y", f"{p}z")
        return f"{x} / nullif({w}, 0) AS {p}_u, {y} / nullif({w}, 0) AS {p}_v, {w} AS {p}_w"

    along = lambda c: f"(1.0::DOUBLE - u) * s{c} + u * e{c}"
    ends = ", ".join(f"{a}{k} AS {p}{a}" for k, p in enumerate("se") for a in AXES)
    squares = " + ".join(["0.0::DOUBLE", *(f"(e{a} - s{a}) * (e{a} - s{a})" for a in AXES)])
    return f""", l0 AS (SELECT *, sqrt({squares}) AS len FROM (SELECT {ends} FROM segs)),
l1 AS (SELECT *, {", ".join(f"(e{a} - s{a}) / len AS d{a}" for a in AXES)}, {", ".join(f"-((e{a} - s{a}) / len) AS bd{a}" for a in AXES)} FROM l0 WHERE len > 0),
l2 AS (SELECT *, {clipped("s", "")} AS ts FROM l1),
l3 AS (SELECT {", ".join(f"s{a} + ts * d{a} AS s{a}" for a in AXES)}, {", ".join(f"e{a}, d{a}, bd{a}" for a in AXES)} FROM l2),
l4 AS (SELECT *, {clipped("e", "b")} AS te FROM l3),
l5 AS (SELECT sx, sy, sz, {", ".join(f"e{a} + te * bd{a} AS e{a}" for a in AXES)} FROM l4),
l6 AS (SELECT {projected("s")}, {projected("e")} FROM l5),
l7 AS (SELECT *, (e_u - s_u) * {0.5 * v.width}::DOUBLE AS dx, (e_v - s_v) * {0.5 * v.height}::DOUBLE AS dy FROM l6 WHERE s_w <> 0 AND e_w <> 0),
l8 AS (SELECT *, ceil(least(sqrt(dx * dx + dy * dy), {float(raster.LINE_STEPS)}::DOUBLE))::INTEGER AS n FROM l7),
l9 AS (SELECT *, k / n::DOUBLE AS u FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM l8 WHERE n > 0)),
l10 AS (SELECT {along("_u")} AS X, {along("_v")} AS Y, {along("_w")} AS depth FROM l9),
frags AS (SELECT greatest(0, least({v.width - 1}, trunc((X * 0.5::DOUBLE + 0.5::DOUBLE) * {v.width})::INTEGER)) AS px, greatest(0, least({v.height - 1}, trunc((Y * 0.5::DOUBLE + 0.5::DOUBLE) * {v.height})::INTEGER)) AS py, depth, {0x0000FF00}::BIGINT AS color
    FROM l10 WHERE abs(X) <= 1 AND abs(Y) <= 1 AND depth > 0)
"""


@query("line_raster", _tree(LINES, WIDE) + _EDGES + ", segs AS (SELECT " + _ENDS + " FROM boxes, edges)" + _lines_sql(DEEP) + _NEAREST)
def _(spark, d):
    edges = view.box_edges(_lines_tree(spark, d)[1], CUBE).withColumn("color", F.lit(0x0000FF00))
    return raster.nearest(raster.line_fragments(edges, DEEP))


def _frustum_sql() -> str:
    """The far side's and the four long edges' ends, taken back to the world by the inverse matrix."""
    back, far = camera.inverse(DEEP.update_transform), 0.99995
    ends = [(x, y, z) for x, y in ((1, 1), (1, -1), (-1, 1), (-1, -1)) for z in (-1.0, far)]
    ends += [(x, y, far) for y in (-1, 1) for x in (-1, 1)] + [(x, y, far) for x in (-1, 1) for y in (-1, 1)]
    rows = ", ".join(f"({k // 2}, {k % 2}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for k, (x, y, z) in enumerate(ends))
    x, y, z, w = _apply(back, "x", "y", "z")
    both = ", ".join(f"round(max({a}) FILTER (stop = {e}), 3) AS {a}{e}" for e in (0, 1) for a in AXES)
    return f"SELECT line::INTEGER AS line, {both} FROM (SELECT line, stop, {x} / {w} AS x, {y} / {w} AS y, {z} / {w} AS z FROM (VALUES {rows}) AS t(line, stop, x, y, z)) GROUP BY line"


@query("frustum_lines", _frustum_sql())
def _(spark, d):
    names = [f"{a}{e}" for e in (0, 1) for a in AXES]
    rows = [(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(raster.frustum_lines(DEEP))]
    return spark.createDataFrame(rows, "line int, " + ", ".join(f"{n} double" for n in names)).select("line", *[F.round(n, 3).alias(n) for n in names])


_LOD = "CASE greatest(0, least(7, trunc((8 - level) * 1.8::DOUBLE)::INTEGER)) " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(colors.SPECTRAL)) + " END"


@query("color_modes", _tree(EVENTS, SMALL) + f"SELECT pid, level, color, ({_LOD})::BIGINT AS lod FROM leaves")
def _(spark, d):
    points, tree = _events_tree(spark, d)
    return octree.leaf_points(points, tree, SMALL, "color").select("pid", "level", "color", colors.lod_color(F.col("level")).alias("lod"))


@query(
    "color_filter_level",
    _tree(EVENTS, SMALL)
    + f""", mixed AS (SELECT px >> 22 AS gx, py >> 22 AS gy, pz >> 22 AS gz, color FROM leaves WHERE level = 3 UNION ALL
SELECT (nx * 16 + vx) >> 1, (ny * 16 + vy) >> 1, (nz * 16 + vz) >> 1, color FROM vox WHERE level = 3)
SELECT gx, gy, gz, ({_MEAN.format(s=0)} + {_MEAN.format(s=8)} * 256 + {_MEAN.format(s=16)} * 65536 + 4278190080)::BIGINT AS color FROM mixed GROUP BY ALL""",
)
def _(spark, d):
    points, tree = _events_tree(spark, d)
    leaves = octree.leaf_points(points, tree, SMALL, "color")
    finer = octree.voxels(points, tree, SMALL, stored).filter("level = 3").select(*[(F.col(f"n{a}") * 16 + F.col(f"v{a}")).alias(f"g{a}") for a in AXES], "color")
    return colorfilter.filter_level(leaves, finer, 2, SMALL)


def _filter_sql(c: TreeConfig) -> str:
    """Level after level, deepest first."""
    out, free = "", 28 - c.grid_bits
    for k in range(c.max_depth - 1, -1, -1):
        finer = "" if k == c.max_depth - 1 else f" UNION ALL SELECT gx >> 1, gy >> 1, gz >> 1, color FROM m{k + 1}"
        out += f""", m{k} AS (SELECT gx, gy, gz, ({_MEAN.format(s=0)} + {_MEAN.format(s=8)} * 256 + {_MEAN.format(s=16)} * 65536 + 4278190080)::BIGINT AS color
    FROM (SELECT px >> {free - k} AS gx, py >> {free - k} AS gy, pz >> {free - k} AS gz, color FROM leaves WHERE level = {k + 1}{finer}) GROUP BY gx, gy, gz)"""
    node = ", ".join(f"g{a} >> {c.grid_bits} AS n{a}" for a in AXES) + ", " + ", ".join(f"g{a} % {c.grid} AS v{a}" for a in AXES)
    return out + " UNION ALL ".join(f" SELECT {k}::INTEGER AS level, {node}, color FROM m{k}" for k in range(c.max_depth))


@query("color_filter", _tree(EVENTS, SMALL) + _filter_sql(SMALL))
def _(spark, d):
    points, tree = _events_tree(spark, d)
    leaves = stored(octree.leaf_points(points, tree, SMALL, "color"), "leaves")
    return colorfilter.filter_colors(leaves, SMALL, materialize=stored)


def _nested_sql(c: TreeConfig) -> str:
    """Level after level from the root: the first of each free cell stays, the others go on."""
    out, free = ", r0 AS (SELECT pid, px, py, pz FROM pts)", 28 - c.grid_bits
    for k in range(c.max_depth + 1):
        at = " AND ".join(f"t.n{a} = r.p{a} >> {28 - k}" for a in AXES)
        out += f""", a{k} AS (SELECT r.*, t.level, t.nx, t.ny, t.nz, t.is_inner FROM r{k} r JOIN tree t ON t.level = {k} AND {at}),
f{k} AS (SELECT min(pid) AS pid FROM a{k} WHERE is_inner GROUP BY {", ".join(f"p{a} >> {free - k}" for a in AXES)}),
r{k + 1} AS (SELECT pid, px, py, pz FROM a{k} ANTI JOIN f{k} USING (pid) WHERE is_inner)"""
    return out + " UNION ALL ".join(f" SELECT pid, level, nx, ny, nz FROM a{k} WHERE NOT is_inner UNION ALL SELECT pid, level, nx, ny, nz FROM a{k} SEMI JOIN f{k} USING (pid)" for k in range(c.max_depth + 1))


@query("nested_samples", _tree(EVENTS, SMALL) + _nested_sql(SMALL))
def _(spark, d):
    points, tree = _events_tree(spark, d)
    return nested.nested_samples(points, tree, SMALL, stored)


# records and colours ---------------------------------------------------------------------------------


@query("dequantize", f"WITH {EVENTS} SELECT pid, (x * 0.0625::DOUBLE + 1000.5::DOUBLE - 8::DOUBLE) AS value FROM pts")
def _(spark, d):
    return event_points(spark, d).select("pid", quantize.dequantize(F.col("x"), 0.0625, 1000.5, -8.0).alias("value"))


@query("quantize", f"WITH {EVENTS} SELECT pid, trunc((y - 300000.25::DOUBLE) / 0.5::DOUBLE + CASE WHEN (y - 300000.25::DOUBLE) / 0.5::DOUBLE >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END)::BIGINT AS value FROM pts")
def _(spark, d):
    return event_points(spark, d).select("pid", quantize.quantize(F.col("y"), 0.5, 300000.25).alias("value"))


@query("rgb_narrow", f"WITH {EVENTS}, c AS (SELECT pid, px % 65536 AS r, py % 65536 AS g, pid % 300 AS b FROM pts) SELECT pid, " + ", ".join(f"(CASE WHEN {c} > 255 THEN {c} // 256 ELSE {c} END)::INTEGER AS {c}" for c in "rgb") + " FROM c")
def _(spark, d):
    p = event_points(spark, d)
    wide = {"r": F.col("px") % 65536, "g": F.col("py") % 65536, "b": F.col("pid") % 300}
    return p.select("pid", *[colors.narrow_channel(c).alias(n) for n, c in wide.items()])


@query("bitfields", f"WITH {EVENTS}, c AS (SELECT pid, (pid % 256)::BIGINT AS f, (pid // 256 % 256)::BIGINT AS k FROM pts) SELECT pid, f & 7 AS return_number, (f >> 3) & 7 AS number_of_returns, (f >> 6) & 1 AS scan_direction, f >> 7 AS edge_of_flight_line, k & 31 AS classification, (k >> 5) & 1 AS synthetic, (k >> 6) & 1 AS keypoint, k >> 7 AS withheld FROM c")
def _(spark, d):
    rows = event_points(spark, d).select("pid", (F.col("pid") % 256).alias("f"), (F.floor(F.col("pid") / 256) % 256).alias("k"))
    return rows.select("pid", *[c.alias(n) for n, c in quantize.legacy_flags(F.col("f"), F.col("k")).items()])


@query("bitfields_extended", f"WITH {EVENTS}, c AS (SELECT pid, (pid % 256)::BIGINT AS f, (pid // 256 % 256)::BIGINT AS k FROM pts) SELECT pid, f & 15 AS return_number, f >> 4 AS number_of_returns, k & 1 AS synthetic, (k >> 1) & 1 AS keypoint, (k >> 2) & 1 AS withheld, (k >> 3) & 1 AS overlap, (k >> 4) & 3 AS scanner_channel, (k >> 6) & 1 AS scan_direction, k >> 7 AS edge_of_flight_line FROM c")
def _(spark, d):
    rows = event_points(spark, d).select("pid", (F.col("pid") % 256).alias("f"), (F.floor(F.col("pid") / 256) % 256).alias("k"))
    return rows.select("pid", *[c.alias(n) for n, c in quantize.extended_flags(F.col("f"), F.col("k")).items()])


@query(
    "las_inventory",
    "SELECT l_linenumber AS return_number, count(*) AS n, " + ", ".join(f"{m}({e}) AS {m}_{a}" for a, e in (("x", "floor(l_extendedprice * 8)::DOUBLE"), ("y", "(l_partkey % 2048 * 512)::DOUBLE"), ("z", "floor(l_quantity * 16384)::DOUBLE")) for m in ("min", "max")) + " FROM lineitem GROUP BY 1",
)
def _(spark, d):
    e = spark.read.parquet(f"{d}/lineitem.parquet")
    points = e.select(F.col("l_linenumber").alias("return_number"), F.floor(F.col("l_extendedprice") * 8).cast("double").alias("x"), (F.col("l_partkey") % 2048 * 512).cast("double").alias("y"), F.floor(F.col("l_quantity") * 16384).cast("double").alias("z"))
    return las.inventory(points)


@query("auto_offset", f"WITH {EMBEDDINGS} SELECT floor((min(x) + max(x)) / 2::DOUBLE / 0.015625::DOUBLE / 1e7::DOUBLE) * 1e7::DOUBLE * 0.015625::DOUBLE AS value FROM pts")
def _(spark, d):
    box = embedding_points(spark, d).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return box.select(quantize.auto_offset(F.col("lo"), F.col("hi"), 0.015625).alias("value"))


@query("overflow_check", f"WITH {EMBEDDINGS} SELECT max(x) / 0.0001220703125::DOUBLE >= 2147483648 AS fine, max(x) >= 2147483648 AS coarse FROM pts")
def _(spark, d):
    box = embedding_points(spark, d).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return box.select(quantize.overflows(F.col("lo"), F.col("hi"), 2.0**-13, 0.0).alias("fine"), quantize.overflows(F.col("lo"), F.col("hi"), 1.0, 0.0).alias("coarse"))


@query("batch_plan", f"WITH {EVENTS}, f AS (SELECT 'events' AS path, count(*) AS n FROM pts) SELECT path, k * 1000 AS first, least(n - k * 1000, 1000) AS count FROM f, range(0, 1000000) AS t(k) WHERE k * 1000 < n")
def _(spark, d):
    found = event_points(spark, d).agg(F.count(F.lit(1)).alias("n_points")).withColumn("path", F.lit("events"))
    return files.batch_plan(found, 1000)


@query("budget_prefix", f"WITH {EVENTS} SELECT pid FROM pts WHERE pid < 777")
def _(spark, d):
    return files.within_budget(event_points(spark, d), 777).select("pid")


@query("dataset_bounds", f"WITH {EVENTS} SELECT count(*) AS n_files, sum(n)::BIGINT AS n_points, " + ", ".join(f"{m}({m}_{a}) AS {m}_{a}" for m in ("min", "max") for a in AXES) + " FROM (SELECT r AS path, count(*) AS n, " + ", ".join(f"{m}({a}) AS {m}_{a}" for m in ("min", "max") for a in AXES) + " FROM pts GROUP BY r)")
def _(spark, d):
    boxes = event_points(spark, d).groupBy("r").agg(F.count(F.lit(1)).alias("n_points"), *[f(a).alias(f"{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in AXES])
    return files.bounds(boxes)


# spatial index ---------------------------------------------------------------------------------------


def _cells(spark, d) -> DataFrame:
    return event_points(spark, d).select("pid", "x", "y", si.cell_index(GRID, F.col("x"), F.col("y")).alias("cell"))


@query("quad_cells", _CELLS + f"SELECT pid, cell, ((cell - {si.level_offset(4)}) >> 4) + {si.level_offset(2)} AS tile FROM cells")
def _(spark, d):
    return _cells(spark, d).select("pid", "cell", si.tile_of(GRID, F.col("cell"), 2).alias("tile"))


@query("cell_intervals", _RUNS + ' SELECT cell, start, "end", "full" FROM runs')
def _(spark, d):
    return si.intervals(_cells(spark, d), 100)


_TOP = _RUNS + """, g AS (SELECT *, start - lag("end") OVER (PARTITION BY cell ORDER BY start) - 1 AS gap FROM runs),
r AS (SELECT *, row_number() OVER (ORDER BY gap DESC NULLS LAST, start, cell) AS k FROM g),
m AS (SELECT *, sum(CASE WHEN gap IS NULL OR k <= greatest(300 - (SELECT count(DISTINCT cell) FROM runs), 0) THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY start) AS island FROM r)
SELECT cell, min(start) AS start, max("end") AS "end", sum("full")::BIGINT AS "full" FROM m GROUP BY cell, island"""


@query("intervals_topk", _TOP)
def _(spark, d):
    return si.keep_largest_gaps(si.intervals(_cells(spark, d), 100), 300)


@query(
    "interval_union",
    _RUNS + """ SELECT min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(new) OVER (ORDER BY start, "end") AS island FROM (SELECT *, CASE WHEN start <= max("end") OVER (ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM runs)) GROUP BY island""",
)
def _(spark, d):
    return si.union_intervals(si.intervals(_cells(spark, d), 100))


_STEP = _CELLS + f""", n AS (SELECT cell, count(*) AS n FROM cells GROUP BY cell), p AS (SELECT cell, n, ((cell - {si.level_offset(4)}) >> 2) + {si.level_offset(3)} AS parent FROM n),
m AS (SELECT parent, sum(n)::BIGINT AS n FROM p GROUP BY parent HAVING count(*) = 4 AND sum(n) < 200)
SELECT parent AS cell, n FROM m UNION ALL SELECT cell, n FROM p WHERE parent NOT IN (SELECT parent FROM m)"""


@query("cell_coarsen_step", _STEP)
def _(spark, d):
    return si.coarsen_step(_cells(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n")), 4, 200)


def _coarsen_sql(levels: int, minimum: int) -> str:
    out = _CELLS + ", c0 AS (SELECT cell, count(*) AS n FROM cells GROUP BY cell)"
    for k, level in enumerate(range(levels, 0, -1)):
        here = f"cell BETWEEN {si.level_offset(level)} AND {si.level_offset(level + 1) - 1}"
        out += f""", p{k} AS (SELECT cell, n, ((cell - {si.level_offset(level)}) >> 2) + {si.level_offset(level - 1)} AS parent FROM c{k} WHERE {here}),
m{k} AS (SELECT parent, sum(n)::BIGINT AS n FROM p{k} GROUP BY parent HAVING count(*) = 4 AND sum(n) < {minimum}),
c{k + 1} AS (SELECT parent AS cell, n FROM m{k} UNION ALL SELECT cell, n FROM p{k} ANTI JOIN m{k} USING (parent) UNION ALL SELECT cell, n FROM c{k} WHERE NOT ({here}))"""
    return out + f" SELECT cell, n FROM c{levels}"


@query("cell_coarsen", _coarsen_sql(4, 400))
def _(spark, d):
    return si.coarsen(_cells(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n")), 4, 400, stored)


@query("range_query", f"WITH {EVENTS} SELECT pid FROM pts WHERE x >= 100000 AND x < 400000 AND y >= 50000 AND y < 300000")
def _(spark, d):
    cells = _cells(spark, d)
    return si.query(cells, stored(si.intervals(cells, 100), "index"), GRID, si.meets_rectangle(*RECTANGLE), si.in_rectangle(*RECTANGLE)).select("pid")


@query("circle_query", f"WITH {EVENTS} SELECT pid FROM pts WHERE (x - 100000) * (x - 100000) + (y - 40000) * (y - 40000) < 3600000000")
def _(spark, d):
    cells = _cells(spark, d)
    return si.query(cells, stored(si.intervals(cells, 100), "index"), GRID, si.meets_circle(*CIRCLE), si.in_circle(*CIRCLE)).select("pid")


@query("adaptive_query", f"WITH {EVENTS} SELECT pid FROM pts WHERE x >= 100000 AND x < 400000 AND y >= 50000 AND y < 300000")
def _(spark, d):
    """The same rectangle, by an index whose cells have several levels."""
    cells = _cells(spark, d)
    coarse = si.coarsen(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), 4, 400, stored).select(F.col("cell").alias("c"))
    kept = [cells.withColumn("c", si.tile_of(GRID, F.col("cell"), k)) for k in range(GRID.levels, -1, -1)]
    rows = None
    for k in kept:
        part = k.join(coarse, "c", "left_semi").select(F.col("c").alias("cell"), "pid")
        rows = part if rows is None else rows.unionByName(part)
    return si.query(cells, stored(si.intervals(stored(rows, "cells"), 100), "index"), GRID, si.meets_rectangle(*RECTANGLE), si.in_rectangle(*RECTANGLE)).select("pid")


@query("cell_occupancy", _CELLS + f"SELECT DISTINCT ((cell - {si.level_offset(4)}) >> 4) + {si.level_offset(2)} AS cell FROM cells")
def _(spark, d):
    return si.occupancy(_cells(spark, d), GRID, 2)


@query("all_cells", f"SELECT {si.level_offset(2)} + " + " + ".join(f"((c{a} >> {k}) & 1) * {1 << (2 * k + o)}" for k in (0, 1) for o, a in enumerate("xy")) + " AS cell, cx * 262144.0::DOUBLE AS x0, (cx + 1) * 262144.0::DOUBLE AS x1, cy * 262144.0::DOUBLE AS y0, (cy + 1) * 262144.0::DOUBLE AS y1 FROM range(0, 4) AS a(cx), range(0, 4) AS b(cy)")
def _(spark, d):
    return si.cell_boxes(spark, GRID, 2)


@query("index_summary", _RUNS + ' SELECT count(DISTINCT cell) AS n_cells, count(*) AS n_intervals, sum("full")::BIGINT AS n_full, sum("end" - start + 1)::BIGINT AS n_total FROM runs')
def _(spark, d):
    return si.summary(si.intervals(_cells(spark, d), 100))


@query("rectangle_boxes", "SELECT r AS tile, min(x) AS min_x FROM pts GROUP BY r HAVING NOT (min(x) >= 400000 OR max(x) < 100000 OR min(y) >= 300000 OR max(y) < 50000)".join([f"WITH {EVENTS} ", ""]))
def _(spark, d):
    boxes = event_points(spark, d).groupBy(F.col("r").alias("tile")).agg(*[f(a).alias(f"{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in "xy"])
    return boxes.filter(files.meets_box(*RECTANGLE)).select("tile", "min_x")


# scalars ----------------------------------------------------------------------------------------------


@query("scalar_clamp_lerp_smoothstep", "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), t AS (SELECT *, least(greatest((a + 0.5::DOUBLE) / 1.0::DOUBLE, 0), 1) AS s FROM e) SELECT vec_id, round(least(greatest(a, -0.1::DOUBLE), 0.1::DOUBLE), 6) AS clamped, round(a + 0.25::DOUBLE * (b - a), 6) AS mixed, round(s * s * (3 - 2 * s), 6) AS smooth, round(a - floor(a), 6) AS fraction FROM t")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate("ab")])
    a, b = F.col("a"), F.col("b")
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("clamped", scalars.clamp(a, -0.1, 0.1)), ("mixed", scalars.lerp(a, b, F.lit(0.25))), ("smooth", scalars.smoothstep(F.lit(-0.5), F.lit(0.5), a)), ("fraction", scalars.fract(a)))])


@query("vector_ops", "WITH e AS (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS v{k}" for k in range(6)) + " FROM embeddings) SELECT vec_id, round(v0*v3 + v1*v4 + v2*v5, 6) AS d, round(sqrt(v0*v0 + v1*v1 + v2*v2), 6) AS len, round(v1*v5 - v2*v4, 6) AS cx, round(v2*v3 - v0*v5, 6) AS cy, round(v0*v4 - v1*v3, 6) AS cz, round(v0 / sqrt(v0*v0 + v1*v1 + v2*v2), 6) AS ux, round(v0 - 2 * v3 * (v0*v3 + v1*v4 + v2*v5), 6) AS rx, least(v0, v3) AS lo, greatest(v0, v3) AS hi FROM e")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"v{k}") for k in range(6)])
    a, b = (tuple(F.col(f"v{k + o}") for k in range(3)) for o in (0, 3))
    cross = scalars.cross(a, b)
    rounded = {"d": scalars.dot(a, b), "len": scalars.length(a), "cx": cross[0], "cy": cross[1], "cz": cross[2], "ux": scalars.normalize(a)[0], "rx": scalars.reflect(a, b)[0]}
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in rounded.items()], scalars.minimum(a, b)[0].alias("lo"), scalars.maximum(a, b)[0].alias("hi"))


@query("frustum_points", f"WITH {EMBEDDINGS} SELECT pid, " + " AND ".join(f"{a!r}::DOUBLE * x + {b!r}::DOUBLE * y + {c!r}::DOUBLE * z + {e!r}::DOUBLE >= 0" for a, b, c, e in camera.frustum_planes(DEEP.transform) if a or b or c) + " AS inside FROM pts")
def _(spark, d):
    p = embedding_points(spark, d)
    return p.select("pid", camera.point_in_frustum(camera.frustum_planes(DEEP.transform), [F.col(a) for a in AXES]).alias("inside"))


@query("string_pad_split", "SELECT p_partkey, repeat(' ', greatest(12 - length(p_name), 0)::BIGINT) || p_name AS padded, p_name || repeat('.', greatest(40 - length(p_name), 0)::BIGINT) AS filled, CASE WHEN strpos(p_name, 'a') > 0 THEN substr(p_name, 1, strpos(p_name, 'a') - 1) || 'A' || substr(p_name, strpos(p_name, 'a') + 1) ELSE p_name END AS replaced, ends_with(lower(p_name), 'e') AS ends, len(list_filter(string_split(p_name || ' ', ' '), lambda x, i: x <> '' OR i < len(string_split(p_name || ' ', ' '))))::INTEGER AS parts FROM part")
def _(spark, d):
    p, n = spark.read.parquet(f"{d}/part.parquet"), F.col("p_name")
    parts = F.size(scalars.split_text(F.concat(n, F.lit(" ")), " "))
    return p.select("p_partkey", scalars.pad_left(n, 12).alias("padded"), scalars.pad_right(n, 40, ".").alias("filled"), scalars.replace_first(n, "a", "A").alias("replaced"), scalars.ends_with_ignoring_case(n, "E").alias("ends"), parts.alias("parts"))


@query("format_thousands", "SELECT p_partkey, replace(format('{:,}', p_partkey * 1234567), ',', '''') AS shown FROM part")
def _(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", scalars.format_thousands(F.col("p_partkey") * 1234567).alias("shown"))

