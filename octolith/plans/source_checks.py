"""Files, cameras and scalars as queries: what is written is read back, and each result stands beside SQL that gives the same rows."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.functions import camera, colors, scalars
from octolith.functions.lattice import AXES
from octolith.operators import raster
from octolith.operators import spatial_index as si
from octolith.plans import catalogue
from octolith.plans.adaptors import EVENTS, event_points
from octolith.sources import files, las, xyzrgba
from octolith.storage import scratch_path

QUERIES: dict[str, catalogue.Query] = {}
ORACLES: dict[str, str] = {}
RGB = ("r", "g", "b")


def query(name: str, sql: str) -> catalogue.Query:
    def add(f: catalogue.Query) -> catalogue.Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _written(points: DataFrame, tasks: int = 3, **options: str) -> str:
    """Points as LAS files; coordinates are multiples of the scale, so they come back exactly."""
    spark, folder = points.sparkSession, scratch_path(points.sparkSession, "las")
    spark.dataSource.register(las.LasSource)
    points.repartition(tasks).write.format("las").mode("append").option("path", folder).options(scale="0.5", offset="0,0,0", **options).save()
    return f"{folder}/part-*.las"


@query("las_round_trip", f"WITH {EVENTS} SELECT x, y, z, r, g, b FROM pts")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = _written(event_points(spark, d).select(*AXES, *RGB))
    return las.read_las(spark, path, translate="false", batch="1000").select(*AXES, *RGB)


@query("las_formats", f"WITH {EVENTS} SELECT k AS format, x, CASE WHEN k IN (2, 3, 5, 7, 8, 10) THEN r ELSE 0 END AS r, CASE WHEN k IN (0, 2) THEN NULL ELSE pid * 0.25::DOUBLE END AS gps_time, pid % 128 AS intensity FROM pts, range(0, 11) AS f(k)")
def _(spark, d):
    """Every point format, with intensity and time where it has them."""
    points = event_points(spark, d).select(*AXES, *RGB, (F.col("pid") * 0.25).alias("gps_time"), (F.col("pid") % 128).cast("int").alias("intensity"))
    out = None
    for k in las.RECORD_BYTES:
        rows = las.read_las(spark, _written(points, 1, point_format=str(k)), translate="false", columns=["x", "r", "gps_time", "intensity"])
        rows = rows.select(F.lit(k).cast("long").alias("format"), "x", "r", F.when(~F.isnan("gps_time"), F.col("gps_time")).alias("gps_time"), F.col("intensity").cast("long").alias("intensity"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("las_columns", f"WITH {EVENTS} SELECT x, g FROM pts")
def _(spark, d):
    """Two columns are asked for, and no others are decoded."""
    return las.read_las(spark, _written(event_points(spark, d).select(*AXES, *RGB)), translate="false", columns=["x", "g"])


@query("las_runs", f"WITH {EVENTS} SELECT pid FROM pts")
def _(spark, d):
    """Many runs of records per file: every record is read once and numbered once."""
    return las.read_las(spark, _written(event_points(spark, d).select(*AXES, *RGB), 2), columns=["pid"], batch="333")


@query("las_extra_attributes", f"WITH {EVENTS} SELECT x, pid * 0.5::DOUBLE AS weight, (pid % 7)::DOUBLE AS kind FROM pts")
def _(spark, d):
    points = event_points(spark, d).select(*AXES, (F.col("pid") * 0.5).alias("weight"), (F.col("pid") % 7).cast("double").alias("kind"))
    return las.read_las(spark, _written(points, extra="weight,kind", point_format="0"), translate="false", columns=["x"], extra=["weight", "kind"])


@query("las_headers", f"WITH {EVENTS} SELECT count(*) AS n_points, " + ", ".join(f"{m}({a}) AS {m}_{a}" for m in ("min", "max") for a in AXES) + " FROM pts")
def _(spark, d):
    """Counts and boxes from the headers alone."""
    return files.bounds(files.file_table(spark, las.expand(_written(event_points(spark, d).select(*AXES, *RGB))))).drop("n_files")


@query("las_metadata", "SELECT * FROM (VALUES (1024::BIGINT, 0::BIGINT, 1::BIGINT, 2::BIGINT, 'second', 6378137.5::DOUBLE), (3072, 0, 1, 32633, 'second', 6378137.5)) AS t(key, location, count, value, note, axis)")
def _(spark, d):
    """Records set, replaced and removed, and read from a written file."""
    vlrs = las.with_geokeys([las.Vlr("own", 7, "", b"x")], [(1, 0, 1, 1)])
    vlrs = las.with_geokeys(las.with_geo_doubles(vlrs, [6378137.5]), [(1024, 0, 1, 2), (3072, 0, 1, 32633)])
    vlrs = las.without_vlr(las.with_geo_ascii(las.with_geo_ascii(vlrs, "first"), "second"), "own", 7)
    path = f"{scratch_path(spark, 'las')}/one.las"
    las.write_las(path, [1.0], [2.0], [3.0], vlrs=vlrs)
    got = las.read_vlrs(path)
    rows = [(*map(int, k), las.geo_ascii(got), las.geo_doubles(got)[0]) for k in las.geokeys(got) if len(got) == 3]
    return spark.createDataFrame(rows, "key long, location long, count long, value long, note string, axis double")


@query("xyzrgba_round_trip", f"WITH {EVENTS} SELECT " + ", ".join(f"{a} - min({a}) OVER () AS {a}" for a in AXES) + ", r, g, b, 255 AS a FROM pts")
def _(spark, d):
    folder = scratch_path(spark, "xyzrgba")
    xyzrgba.write_xyzrgba(event_points(spark, d).select(*AXES, *RGB).repartition(3), folder)
    return xyzrgba.read_xyzrgba(spark, f"{folder}/part-*.xyzrgba", batch="1000").select(*AXES, *RGB, "a")


_HALF = ", ".join(f"{a} - min({a}) OVER () AS {a}" for a in AXES)


@query("files_union", f"WITH {EVENTS} SELECT pid, count(*) OVER () AS n_points FROM pts")
def _(spark, d):
    """Files of two kinds as one table, numbered through."""
    points = event_points(spark, d)
    folder = scratch_path(spark, "xyzrgba")
    xyzrgba.write_xyzrgba(points.filter("pid % 2 = 1").select(*AXES, *RGB).repartition(2), folder)
    paths = las.expand(_written(points.filter("pid % 2 = 0").select(*AXES, *RGB))) + las.expand(f"{folder}/part-*.xyzrgba")
    rows = files.read_points(spark, paths)
    return rows.select("pid", F.lit(rows.count()).cast("long").alias("n_points"))


@query("index_file", catalogue._RUNS + ' SELECT cell, start, "end", "full" FROM runs')
def _(spark, d):
    path = scratch_path(spark, "index")
    si.write_index(si.intervals(catalogue._cells(spark, d), 100), path)
    return si.read_index(spark, path)


@query("tile_index", catalogue._CELLS + f", t AS (SELECT pid, cell, cell - {si.level_offset(4)} AS path FROM cells) SELECT pid, CASE WHEN path >> 4 = 3 THEN {si.level_offset(2)} + path % 16 END AS own, CASE WHEN path >> 4 = 3 THEN cell END AS whole FROM t")
def _(spark, d):
    """Numbers within one tile of the tree, and back."""
    grid, tile = catalogue.GRID, si.level_offset(2) + 3
    rows = event_points(spark, d).select("pid", si.subtile_index(grid, F.col("x"), F.col("y"), tile, 2).alias("own"))
    return rows.withColumn("whole", si.whole_index(grid, F.col("own"), tile, 2))


@query("mesh", f"WITH {EVENTS}, f AS (SELECT pid AS face FROM pts WHERE pid < (SELECT count(*) FROM pts) - 2), c AS (SELECT face, unnest([0, 1, 2])::INTEGER AS corner FROM f) SELECT face, corner, x, y, z, (pid % 7)::DOUBLE AS u, (pid % 5)::DOUBLE AS v FROM c JOIN pts ON pid = face + corner")
def _(spark, d):
    """A strip of triangles over all points, written as text and read in splits."""
    p = event_points(spark, d).select("pid", *[F.col(a).cast("long").cast("string").alias(a) for a in AXES])
    n = p.count()
    text = p.select(F.lit(0).alias("k"), "pid", F.concat_ws(" ", F.lit("v"), *AXES).alias("text"))
    text = text.union(p.select(F.lit(1), "pid", F.concat_ws(" ", F.lit("vt"), F.col("pid") % 7, F.col("pid") % 5)))
    corner = [F.concat_ws("/", F.col("pid") + k, F.col("pid") + k) for k in (1, 2, 3)]
    text = text.union(p.filter(F.col("pid") < n - 2).select(F.lit(2), "pid", F.concat_ws(" ", F.lit("f"), *corner)))
    folder = scratch_path(spark, "mesh")
    text.repartition(1).sortWithinPartitions("k", "pid").select("text").write.text(folder)
    return files.read_obj(spark, folder)


def _read_ppm(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of a picture file, from the bottom row up (bounded by the viewport)."""
    store, place = las.store_of(path)
    with store.open_input_file(place) as file:
        data = io.BytesIO(file.read())
    _, width, height, _ = data.readline().split()
    w, h, octets = int(width), int(height), data.read()
    rows = [(k % w, h - 1 - k // w, *octets[3 * k : 3 * k + 3]) for k in range(w * h)]
    return spark.createDataFrame(rows, "px int, py int, r int, g int, b int")


_PICTURE = f", near AS ({catalogue._NEAREST}), image AS (SELECT i, coalesce(color, {colors.BACKGROUND}) AS color FROM range(0, 4096) AS t(i) LEFT JOIN near ON px + py * 64 = i) SELECT (i % 64)::INTEGER AS px, (i // 64)::INTEGER AS py, (color & 255)::INTEGER AS r, ((color >> 8) & 255)::INTEGER AS g, ((color >> 16) & 255)::INTEGER AS b FROM image"


@query("picture_file", f"WITH {EVENTS}" + catalogue._frags("pts", catalogue.DEEP) + _PICTURE)
def _(spark, d):
    path = f"{scratch_path(spark, 'picture')}/view.ppm"
    image = raster.filled(raster.nearest(raster.fragments(event_points(spark, d), catalogue.DEEP)), catalogue.DEEP)
    files.write_ppm(image, path, 64, 64)
    return _read_ppm(spark, path)


# cameras and scalars ---------------------------------------------------------------------------------


def _presets_sql() -> str:
    rows = ", ".join(f"('{n}', {y}::DOUBLE, {p}::DOUBLE, {r}::DOUBLE, {t[0]}::DOUBLE, {t[1]}::DOUBLE, {t[2]}::DOUBLE)" for n, (y, p, r, t) in camera.PRESETS.items())
    return f"""SELECT name, round(tx + radius * cos(pitch) * sin(yaw), 6) AS x, round(ty - radius * cos(pitch) * cos(yaw), 6) AS y, round(tz - radius * sin(pitch), 6) AS z, round(radius, 6) AS depth
    FROM (VALUES {rows}) AS t(name, yaw, pitch, radius, tx, ty, tz)"""


@query("camera_presets", _presets_sql())
def _(spark, d):
    """Where the eye of each named view is, and how far in front of it its target lies."""
    rows = [(n, *(float(v) for v in camera.eye_of(n)), float(camera.apply_numbers(camera.preset(n), p[3])[3])) for n, p in camera.PRESETS.items()]
    out = spark.createDataFrame(rows, "name string, x double, y double, z double, depth double")
    return out.select("name", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "depth")])


@query("matrix_transpose", "SELECT i::INTEGER AS i, j::INTEGER AS j, (j * 4 + i)::DOUBLE AS value FROM range(0, 4) AS a(i), range(0, 4) AS b(j)")
def _(spark, d):
    m = camera.transpose(tuple(tuple(float(4 * i + j) for j in range(4)) for i in range(4)))
    return spark.createDataFrame([(i, j, m[i][j]) for i in range(4) for j in range(4)], "i int, j int, value double")


_SIX = "WITH e AS (SELECT vec_id, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS v{k}" for k in range(6)) + " FROM embeddings) "


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[Column, ...], tuple[Column, ...]]:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"v{k}") for k in range(6)])
    return e, *(tuple(F.col(f"v{k + o}") for k in range(3)) for o in (0, 3))


def _named(**vectors: tuple[Column, ...]) -> list[Column]:
    return [F.round(c, 6).alias(f"{n}{a}") for n, v in vectors.items() for a, c in zip(AXES, v, strict=True)]


@query("vector_arithmetic", _SIX + "SELECT vec_id, " + ", ".join(f"round({e.format(p=f'v{k}', q=f'v{k + 3}')}, 6) AS {n}{a}" for n, e in (("add_", "{p} + {q}"), ("sub_", "{p} - {q}"), ("mul_", "{p} * {q}"), ("div_", "{p} / ({q} + 8)"), ("by_", "{p} * 2.5::DOUBLE")) for k, a in enumerate(AXES)) + " FROM e")
def _(spark, d):
    e, a, b = _vectors(spark, d)
    eight = tuple(x + F.lit(8.0) for x in b)
    return e.select("vec_id", *_named(add_=scalars.add(a, b), sub_=scalars.subtract(a, b), mul_=scalars.multiply(a, b), div_=scalars.divide(a, eight), by_=scalars.scale(a, 2.5)))


@query("scalar_functions", _SIX + "SELECT vec_id, round(v0 * 10 - trunc(v0 * 10 / 3) * 3, 6) AS remainder, round(abs(v0), 6) AS size, round(1 / sqrt(v0 * v0 + 1), 6) AS rsqrt, round(pow(v0 + 2, v1), 6) AS power, round(exp(v0), 6) AS e, round(log2(v0 + 2), 6) AS l, round(sin(v0), 6) AS s, round(cos(v0), 6) AS c FROM e")
def _(spark, d):
    e, a, _ = _vectors(spark, d)
    x = a[0]
    named = {"remainder": scalars.modulo(x * 10, F.lit(3.0)), "size": F.abs(x), "rsqrt": scalars.inverse_sqrt(x * x + 1), "power": F.pow(x + 2, a[1]), "e": F.exp(x), "l": F.log2(x + 2), "s": F.sin(x), "c": F.cos(x)}
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in named.items()])


@query("random_vectors", "SELECT vec_id, " + ", ".join(f"-1 + ('0x' || md5(vec_id::VARCHAR || ':{15 + k}')[1:8])::BIGINT / 4294967296.0::DOUBLE * 2 AS {a}" for k, a in enumerate(AXES)) + " FROM embeddings")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", *[c.alias(a) for a, c in zip(AXES, scalars.random_vector(F.col("vec_id"), 3, 5, -1.0, 1.0), strict=True)])


@query("planes_and_rays", _SIX + """SELECT vec_id, round(v0 * 0.6 + v1 * 0.8 + 0.25, 6) AS distance, CASE WHEN v3 * 0.6 + v4 * 0.8 > 0 AND -(v0 * 0.6 + v1 * 0.8 + 0.25) / (v3 * 0.6 + v4 * 0.8) >= 0
THEN round(-(v0 * 0.6 + v1 * 0.8 + 0.25) / (v3 * 0.6 + v4 * 0.8), 5) END AS hit FROM e""".replace("0.6", "0.6::DOUBLE").replace("0.8", "0.8::DOUBLE").replace("0.25", "0.25::DOUBLE"))
def _(spark, d):
    e, a, b = _vectors(spark, d)
    normal, constant = (F.lit(0.6), F.lit(0.8), F.lit(0.0)), F.lit(0.25)
    return e.select("vec_id", F.round(scalars.distance_to_plane(normal, constant, a), 6).alias("distance"), F.round(scalars.ray_to_plane(a, b, normal, constant), 5).alias("hit"))


@query("string_compare", "SELECT p_partkey, lower(p_name) = lower(upper(p_name)) AS same, lower(p_name) = lower(p_type) AS other, length(p_name)::INTEGER AS size, p_name = p_name || '' AS equal, repeat('ab', 3) AS thrice FROM (SELECT p_partkey, p_name, p_name || 'x' AS p_type FROM part)")
def _(spark, d):
    n = F.col("p_name")
    rows = spark.read.parquet(f"{d}/part.parquet").withColumn("p_type", F.concat(n, F.lit("x")))
    return rows.select("p_partkey", scalars.equals_ignoring_case(n, F.upper(n)).alias("same"), scalars.equals_ignoring_case(n, F.col("p_type")).alias("other"), F.length(n).alias("size"), (n == F.concat(n, F.lit(""))).alias("equal"), F.repeat(F.lit("ab"), 3).alias("thrice"))


@query("node_colors", catalogue._tree(EVENTS, catalogue.SMALL) + "SELECT pid, ((1::BIGINT << (3 * level)) + code) % 127 * 123456789 % 4294967296 AS color FROM (SELECT pid, level, " + " + ".join(f"(((n{a} >> {k}) & 1) << {3 * k + s})" for k in range(5) for a, s in (("x", 2), ("y", 1), ("z", 0))) + " AS code FROM leaves)")
def _(spark, d):
    """The colour that tells nodes apart, of each point's leaf."""
    from octolith.functions.lattice import morton, node_id
    from octolith.operators import octree

    points, tree = catalogue._events_tree(spark, d)
    number = node_id(F.col("level"), morton(F.col("nx"), F.col("ny"), F.col("nz")))
    return octree.leaf_points(points, tree, catalogue.SMALL).select("pid", colors.node_color(number).alias("color"))


@query("filter_accounts_for_all", "SELECT 0::BIGINT AS n")
def _(spark, d):
    """Voxels that the colour filter lost or made up: none."""
    from octolith.operators import colorfilter, octree
    from octolith.storage import stored

    points, tree = catalogue._events_tree(spark, d)
    leaves = stored(octree.leaf_points(points, tree, catalogue.SMALL, "color"), "leaves")
    filtered = colorfilter.filter_colors(leaves, catalogue.SMALL, materialize=stored)
    return colorfilter.unaccounted(filtered, octree.voxels(points, tree, catalogue.SMALL, stored)).agg(F.count(F.lit(1)).alias("n"))


@query("grid_setup", "SELECT 5::INTEGER AS levels, 32::INTEGER AS side, -120.0::DOUBLE AS min_x, -20.0::DOUBLE AS min_y")
def _(spark, d):
    """A square of cells around a box: snapped to cells, padded to a power of two."""
    g = si.Grid.around((-5.0, 20.0), (95.0, 250.0), 10.0)
    return spark.createDataFrame([(g.levels, g.side, g.min_x, g.min_y)], "levels int, side int, min_x double, min_y double")
