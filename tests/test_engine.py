"""The point-cloud engine: hand-made trees, properties, files and streams."""

import os
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
from octolith.config import Cube, TreeConfig, View
from octolith.functions import camera, lattice, quantize, scalars
from octolith.operators import colorfilter, nested, octree, raster, view
from octolith.operators import spatial_index as si
from octolith.sources import files, las, xyzrgba
from octolith.streaming.build import BuildState, read_stream, start

SF = "/root/testdata/sf0.001"


def table(spark, points, cube):
    rows = spark.createDataFrame([(k, *map(float, p), k * 7) for k, p in enumerate(points, start=1)], "pid long, x double, y double, z double, color long")
    return lattice.with_lattice(rows, cube)


def test_golden(spark):
    config, cube = TreeConfig(max_points=2, max_depth=2, grid=2), Cube(size=8.0)
    points = table(spark, [(0, 0, 0), (1, 1, 1), (7, 7, 7), (6, 0, 0)], cube)
    tree = octree.nodes(points, config).cache()
    some = octree.voxels(points, tree, config)
    row = octree.stats(octree.with_voxel_counts(tree, some), config).first()
    assert (row.n_nodes, row.n_inner, row.n_leaves, row.n_nonempty_leaves, row.n_points, row.n_voxels) == (9, 1, 8, 3, 4, 3)
    assert {(r.vx, r.vy, r.vz): r.first_pid for r in some.collect()} == {(0, 0, 0): 1, (1, 0, 0): 4, (1, 1, 1): 3}
    assert {r.pid: (r.nx, r.ny, r.nz) for r in octree.leaf_points(points, tree, config).collect()} == {1: (0, 0, 0), 2: (0, 0, 0), 3: (1, 1, 1), 4: (1, 0, 0)}


def tree_of(points, config):
    """Inserting point by point, splitting nodes that overflow."""
    count = {}
    for p in points:
        for level in range(config.max_depth + 1):
            key = (level, *[c >> (28 - level) for c in p])
            count[key] = count.get(key, 0) + 1
    out, todo = {}, [(0, 0, 0, 0)]
    while todo:
        level, *c = todo.pop()
        n = count.get((level, *c), 0)
        inner = n > config.max_points and level < config.max_depth
        out[level, *c] = (n, inner)
        if inner:
            todo += [(level + 1, *[2 * a + b for a, b in zip(c, corner, strict=True)]) for corner in np.ndindex(2, 2, 2)]
    return out


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, 2**28 - 1)] * 3), min_size=0, max_size=80), st.integers(1, 6))
def test_tree(spark, points, most):
    config = TreeConfig(max_points=most, max_depth=9, grid=4)
    points = points + points[:2] * 3
    rows = spark.createDataFrame([(k, *p, k) for k, p in enumerate(points)], "pid long, px long, py long, pz long, color long")
    tree = octree.nodes(rows, config)
    assert {(r.level, r.nx, r.ny, r.nz): (r.n_points, r.is_inner) for r in tree.collect()} == tree_of(points, config)


def test_max_face(spark):
    rows = spark.createDataFrame([(8.0,)], "x double")
    assert rows.select(lattice.lattice_coordinate(F.col("x"), 0.0, 8.0)).first()[0] == 2**28 - 1
    assert rows.select(lattice.lattice_coordinate(F.col("x"), 0.0, 8.0, wrap_max_face=True)).first()[0] == 0


def test_morton(spark):
    code = lattice.morton(F.lit(5).cast("long"), F.lit(3).cast("long"), F.lit(6).cast("long"))
    want = sum((5 >> k & 1) << 3 * k + 2 | (3 >> k & 1) << 3 * k + 1 | (6 >> k & 1) << 3 * k for k in range(3))
    row = spark.range(1).select(code.alias("c"), lattice.node_name(F.lit(3), code).alias("n"), lattice.morton(*[F.lit(2**21 - 1).cast("long")] * 3).alias("all")).first()
    assert (row.c, row.n, row.all) == (want, f"r{want:03o}", 2**63 - 1)


def test_nested_and_filter(spark):
    rng = np.random.default_rng(1)
    config, cube = TreeConfig(max_points=5, max_depth=3, grid=2), Cube(size=1.0)
    points = table(spark, rng.random((120, 3)), cube).cache()
    tree = octree.nodes(points, config).cache()
    got = nested.nested_samples(points, tree, config).collect()
    assert sorted(r.pid for r in got) == list(range(1, 121))
    some = octree.voxels(points, tree, config)
    filtered = colorfilter.filter_colors(octree.leaf_points(points, tree, config, "color"), config)
    assert colorfilter.unaccounted(filtered, some).count() == 0


def test_views(spark):
    eye = camera.orbit_view(0.4, -0.6, 30.0, (1.0, 2.0, 3.0))
    x, y, _, w = camera.apply_numbers(eye, (1.0, 2.0, 3.0))
    assert abs(x) < 1e-9 and abs(y) < 1e-9 and w == pytest.approx(30.0)
    back = camera.multiply(eye, camera.inverse(eye))
    assert np.allclose(back, np.eye(4))
    v = View(eye, 100, 80)
    planes = camera.frustum_planes(eye)
    rows = spark.createDataFrame([(1.0, 2.0, 3.0), (500.0, 0.0, 0.0)], "x double, y double, z double")
    assert [r[0] for r in rows.select(camera.point_in_frustum(planes, [F.col(c) for c in "xyz"])).collect()] == [True, False]
    drawn = raster.nearest(raster.fragments(rows.withColumn("color", F.lit(5).cast("long")), v)).collect()
    assert [(r.px, r.py, r.color) for r in drawn] == [(50, 40, 5)]
    shade = raster.shaded(raster.filled(spark.createDataFrame([(50, 40, 30.0, 5)], "px int, py int, depth double, color long"), v), v)
    assert {(r.px, r.py): r.color & 0xFFFFFF for r in shade.collect()}[0, 0] == 0x332211 and shade.count() == 8000


def test_lines(spark):
    v = View(((1.0, 0, 0, 0), (0, 1.0, 0, 0), (0, 0, 1.0, 0), (0, 0, 0, 1.0)), 10, 10)
    line = spark.createDataFrame([(-5.0, 0.05, 0.0, 5.0, 0.05, 0.0, 9)], "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, color long")
    got = {(r.px, r.py) for r in raster.line_fragments(line, v).collect()}
    assert got <= {(k, 5) for k in range(10)} and len(got) >= 9 and {(0, 5), (9, 5)} <= got  # a step may round into the pixel before


def test_strings(spark):
    row = spark.createDataFrame([("a.b.", "Tom")], "s string, n string").select(
        scalars.split_text(F.col("s"), ".").alias("parts"), scalars.pad_left(F.col("n"), 2).alias("l"), scalars.pad_left(F.col("n"), 5).alias("ll"), scalars.replace_first(F.lit("xaxa"), "a", "b").alias("r"), scalars.format_thousands(F.lit(1234567)).alias("f"), scalars.equals_ignoring_case(F.col("n"), F.lit("tOM")).alias("e"),
    ).first()
    assert tuple(row) == (["a", "b"], "Tom", "  Tom", "xbxa", "1'234'567", True)


def test_quantize(spark):
    rows = spark.createDataFrame([(0.5,), (-0.5,), (1.49,), (-1.5,)], "v double").select(quantize.quantize(F.col("v"), 1.0, 0.0))
    assert [r[0] for r in rows.collect()] == [1, -1, 1, -2]


def test_overflows(spark):
    """However far a bound lies outside: by whole turns of 32 bits, where its sign comes back, and beyond 64 bits."""
    bounds = [(0.0, 2.0**31 - 1), (-(2.0**31), 0.0), (-(2.0**31) - 0.25, 2.0**31 - 0.75), (0.0, 2.0**31 - 0.5), (0.0, 2.0**31), (-(2.0**31) - 0.5, 0.0), (-(2.0**31) - 1, 0.0)]
    far = [(1.0, 2.0**32 + 5), (-(2.0**32) - 5, -1.0), (1.0, 1.4 * 2.0**32), (1.0, 2.0**32), (0.0, 1e300), (-1e300, 0.0)]
    rows = spark.createDataFrame([(k, *b) for k, b in enumerate(bounds + far)], "k int, low double, high double")
    got = rows.orderBy("k").select(quantize.overflows(F.col("low"), F.col("high"), 1.0, 0.0), quantize.overflows(F.col("low") * 0.5 + 8, F.col("high") * 0.5 + 8, 0.5, 8.0)).collect()
    assert [r[0] for r in got] == [False] * 3 + [True] * (len(bounds + far) - 3)
    assert [r[1] for r in got] == [r[0] for r in got]


@pytest.mark.parametrize("ends", [(-0.6, 0.4), (-0.6, 0.1), (-0.6, -0.55), (0.1, 0.4), (-0.6, 0.6), (-0.5, -0.5), (0.0, 0.0), (-0.6, 5000.0), (-0.6, 1e13), (-0.6, None), None])
def test_overflow_check(spark, tmp_path, ends):
    """The upper bound one turn of 32 bits above, the lower one inside; a null embedding, no row."""
    vectors = [] if ends is None else [None if e is None else [e] * 64 for e in ends]
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(__spark_entry__.oracle_sql()["overflow_check"]).fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()["overflow_check"](spark, str(tmp_path)).collect()] == want


@pytest.mark.parametrize("kind", [0, 2, 3, 5, 7, 8, 10])
def test_las(spark, tmp_path, kind):
    rng = np.random.default_rng(kind)
    xyz = rng.random((2500, 3)) * 100 + 1000
    rgb = rng.integers(0, 256 if kind % 2 else 65536, (2500, 3))
    path = f"{tmp_path}/a.las"
    las.write_las(path, *xyz.T, point_format=kind, rgb=rgb, vlrs=[las.Vlr("LASF_Projection", 34735, "keys", struct.pack("<8H", 1, 1, 0, 1, 1024, 0, 1, 2))])
    h = las.read_header(path)
    assert h.n_points == 2500 and h.point_format == kind and np.allclose(h.low, xyz.min(axis=0))
    assert las.geokeys(las.read_vlrs(path)) == [(1024, 0, 1, 2)]
    got = las.read_las(spark, path, batch="1000", translate="false").orderBy("pid").toPandas()
    assert np.abs(got[["x", "y", "z"]].to_numpy() - xyz).max() < 0.00051
    want = np.where(rgb > 255, rgb // 256, rgb) if kind in las.RGB_AT else np.zeros_like(rgb)
    assert (got[["r", "g", "b"]].to_numpy() == want).all() and (got.a == 255).all()
    assert las.read_las(spark, path, columns=["x"]).columns == ["x"]
    moved = las.read_las(spark, path).agg(*[F.min(c) for c in "xyz"]).first()
    assert np.abs(np.array(moved)).max() < 0.001


def test_files(spark, tmp_path):
    points = spark.range(500).select("id", *[(F.col("id") * k + 5).cast("double").alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))], *[(F.col("id") % 256).cast("int").alias(c) for c in "rgb"])
    folder = f"{tmp_path}/q"
    assert xyzrgba.write_xyzrgba(points.repartition(3), folder) == 500
    parts = sorted(f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".xyzrgba"))
    low, high, _ = xyzrgba.read_box(parts[0])
    assert low == (0.0, 0.0, 0.0) and high == (499.0, 998.0, 1497.0)
    las.write_las(f"{tmp_path}/b.LAS", [0.0, 9.0], [0.0, 9.0], [0.0, 9.0])
    files.register_suffix(".Raw16")
    os.rename(parts[0], f"{tmp_path}/z.raw16")
    parts[0] = f"{tmp_path}/z.raw16"
    paths = [*parts, f"{tmp_path}/b.LAS", f"{tmp_path}/missing.las", f"{tmp_path}/x.txt"]
    got = files.read_points(spark, paths)
    assert got.count() == 502 and got.select("pid").distinct().count() == 502 and got.agg(F.max("pid")).first()[0] == 501
    box = files.bounds(files.file_table(spark, paths)).first()
    assert (box.n_points, box.max_z, files.cube_of(box).size) == (502, 1497.0, 1497.0)
    assert files.batch_plan(files.file_table(spark, paths), 100).agg(F.sum("count")).first()[0] == 502
    with open(f"{tmp_path}/c.laz", "wb") as f:
        data = bytearray(open(f"{tmp_path}/b.LAS", "rb").read())
        data[104] |= 0x80
        f.write(data)
    with pytest.raises(Exception, match="LAZ"):
        las.read_las(spark, f"{tmp_path}/c.laz").count()
    points.select("x", "y", "z", "r", "g", "b").write.format("noop").mode("overwrite").save()


def test_las_sink(spark, tmp_path):
    spark.dataSource.register(las.LasSource)
    points = spark.range(100).select(*[F.col("id").cast("double").alias(c) for c in "xyz"], *[F.lit(9).alias(c) for c in "rgb"])
    points.repartition(2).write.format("las").mode("append").option("path", f"{tmp_path}/out").save()
    assert las.read_las(spark, f"{tmp_path}/out/*.las").agg(F.sum("x")).first()[0] == pytest.approx(4950)


def test_mesh(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 0\nvt 1 0\nvt 0 1\nf 1/1 2/2 3/3\nf 3/3 2/2 1/1\n")
    got = files.read_obj(spark, f"{tmp_path}/m.obj").orderBy("face", "corner").collect()
    assert [(r.face, r.x, r.v) for r in got] == [(0, 0.0, 0.0), (0, 1.0, 0.0), (0, 0.0, 1.0), (1, 0.0, 1.0), (1, 1.0, 0.0), (1, 0.0, 0.0)]


def test_grid():
    g = si.Grid.around((-5.0, 20.0), (95.0, 250.0), 10.0)
    assert (g.levels, g.side) == (5, 32) and g.min_x <= -10 and g.min_x + g.side * 10 > 95
    assert [si.level_offset(k) for k in range(4)] == [0, 1, 5, 21]


def test_index(spark, tmp_path):
    rng = np.random.default_rng(2)
    grid = si.Grid.around((0.0, 0.0), (1000.0, 1000.0), 100.0)
    pts = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(rng.random((600, 2)) * 1000)], "pid long, x double, y double")
    cells = pts.withColumn("cell", si.cell_index(grid, F.col("x"), F.col("y"))).cache()
    runs = si.intervals(cells, 20)
    si.write_index(runs, f"{tmp_path}/lax")
    index = si.read_index(spark, f"{tmp_path}/lax").cache()
    for low, high in (((100.0, 100.0), (300.0, 550.0)), ((0.0, 0.0), (0.5, 0.5))):
        got = si.query(cells, index, grid, si.meets_rectangle(low, high), si.in_rectangle(low, high))
        assert {r.pid for r in got.collect()} == {r.pid for r in cells.filter(si.in_rectangle(low, high)).collect()}
        assert got.count() == got.distinct().count()
    less = si.keep_largest_gaps(index, 150)
    assert less.count() == max(150, less.select("cell").distinct().count())
    assert less.agg(F.sum("full")).first()[0] == 600


@pytest.mark.parametrize("backwards", [False, True])
def test_stream(spark, tmp_path, backwards):
    config = TreeConfig(max_points=4, max_depth=4, grid=4)
    rng = np.random.default_rng(3)
    rows = [(k, *map(int, p)) for k, p in enumerate(rng.integers(0, 2**28, (90, 3)))]
    schema = "pid long, px long, py long, pz long"
    batches = [rows[k : k + 30] for k in range(0, 90, 30)] + [[]]
    for n, b in enumerate(reversed(batches) if backwards else batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{n}")
        for f in os.listdir(f"{tmp_path}/in{n}"):
            if f.endswith(".parquet"):
                os.makedirs(f"{tmp_path}/all", exist_ok=True)
                os.replace(f"{tmp_path}/in{n}/{f}", f"{tmp_path}/all/{n}-{f}")
    state = BuildState(f"{tmp_path}/state", config)
    assert state.processed(spark) == 0
    points = spark.createDataFrame(rows, schema)
    start(read_stream(spark, f"{tmp_path}/all", points.schema), state).awaitTermination()
    want = {tuple(r) for r in octree.cell_counts(points, 0, 4).collect()}
    assert {tuple(r) for r in state.node_counts(spark).collect()} == want and state.processed(spark) == 90
    start(read_stream(spark, f"{tmp_path}/all", points.schema), state).awaitTermination()  # nothing new
    assert state.processed(spark) == 90
    state.reset(spark)
    assert state.processed(spark) == 0


def test_storage(spark):
    from octolith import storage

    storage.drop_stored(spark)
    kept = storage.stored(spark.range(5).withColumnRenamed("id", "n"))
    assert kept.columns == ["n"] and kept.count() == 5
    assert storage.drop_stored(spark) == 1


def test_line_raster_draws_all_nodes(spark):
    from octolith.plans import catalogue

    _, nodes = catalogue._lines_tree(spark, SF)
    assert nodes.filter("level > 2").count() > 0
    edges = view.box_edges(nodes, catalogue.CUBE).withColumn("color", F.lit(0x0000FF00))
    want = {tuple(r) for r in raster.nearest(raster.line_fragments(edges, catalogue.DEEP)).select("px", "py", "depth", "color").collect()}
    got = {tuple(r) for r in __spark_entry__.queries()["line_raster"](spark, SF).select("px", "py", "depth", "color").collect()}
    assert got == want


CHEAP = ["lattice_project", "morton_code", "cell_counts", "image_nearest", "image_hqs", "quantize", "bitfields", "cell_intervals", "intervals_topk", "interval_union", "cell_coarsen_step", "range_query", "circle_query", "vector_ops", "string_pad_split"]


@pytest.mark.parametrize("name", CHEAP)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    names = sorted(want.columns)
    assert names == sorted(got.columns)
    assert sorted(map(tuple, got.select(*[f"`{c}`" for c in names]).collect())) == sorted(want.select(*[f'"{c}"' for c in names]).fetchall())


def test_passes_give_the_same_tree(spark, monkeypatch):
    """Levels worked off two at a time: nodes, leaves and voxels as from a single pass, and as from each point's path."""
    rng = np.random.default_rng(9)
    rows = [(k, *map(int, p), int(k * 7 % 256)) for k, p in enumerate((rng.random((400, 3)) ** 3 * 2**28).astype(int))]
    points = spark.createDataFrame(rows, "pid long, px long, py long, pz long, color long").cache()
    config = TreeConfig(max_points=6, max_depth=7, grid=4)
    tree = octree.nodes(points, config).cache()
    want = [sorted(map(tuple, t.collect())) for t in (tree, octree.voxels(points, tree, config))]
    monkeypatch.setattr(octree, "LEVELS_PER_PASS", 2)
    monkeypatch.setattr(octree, "VOXEL_LEVELS_PER_PASS", 2)
    stored_ = lambda df: spark.createDataFrame(df.collect(), df.schema)
    got = [sorted(map(tuple, t.collect())) for t in (octree.nodes(points, config, stored_), octree.voxels(points, tree, config, stored_))]
    assert got == want
    inner = {(r.level, r.nx, r.ny, r.nz) for r in tree.collect() if r.is_inner}
    leaves = {r.pid: (r.level, r.nx, r.ny, r.nz) for r in octree.leaf_points(points, tree, config).collect()}
    for pid, x, y, z, _ in rows:
        level = next(k for k in range(9) if (k, x >> 28 - k, y >> 28 - k, z >> 28 - k) not in inner)
        assert leaves[pid] == (level, x >> 28 - level, y >> 28 - level, z >> 28 - level)


def test_stream_voxels_budget_and_steps(spark, tmp_path):
    """State of points with colours; a budget that counts what it leaves out; one batch a step."""
    from octolith.streaming import build

    config = TreeConfig(max_points=4, max_depth=3, grid=4)
    rng = np.random.default_rng(5)
    rows = [(k, *map(int, p), k) for k, p in enumerate(rng.integers(0, 2**28, (60, 3)))]
    schema = "pid long, px long, py long, pz long, color long"
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], schema).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    state, seen = build.BuildState(f"{tmp_path}/state", config), []
    while build.step(stream, state, max_points=50):
        seen.append(state.processed(spark))
    assert len(seen) == 3 and seen[-1] == 50 and seen == sorted(seen)
    assert tuple(state.capacity(spark).first()) == (50, 10, True)
    points = spark.createDataFrame(rows[:50], schema)
    tree = octree.nodes(points, config)
    assert sorted(map(tuple, state.voxels(spark).collect())) == sorted(map(tuple, octree.voxels(points, tree, config).collect()))
    state.reset(spark)
    assert state.processed(spark) == 0 and state.voxels(spark).count() == 0


def test_las_extras_and_records(spark, tmp_path):
    """Extra attributes with scale and offset, files that lack them, records set and removed; files larger than a batch stream through."""
    extras = [las.Extra("height", "<i2", 0.5, 10.0), las.Extra("weight")]
    n = np.arange(500.0)
    vlrs = las.with_vlr(las.with_vlr([], las.Vlr("a", 1, "", b"old")), las.Vlr("a", 1, "", b"new"))
    las.write_las(f"{tmp_path}/one.las", n, n, n, point_format=1, vlrs=vlrs, extras=extras, height=n, weight=n * 3, gps_time=n)
    las.write_las(f"{tmp_path}/two.las", [1.0], [1.0], [1.0])
    assert [v.data for v in las.read_vlrs(f"{tmp_path}/one.las")][0] == b"new" and las.extras_of(las.read_vlrs(f"{tmp_path}/one.las")) == extras
    got = las.read_las(spark, f"{tmp_path}/one.las", f"{tmp_path}/two.las", columns=["x", "gps_time"], extra=["height", "weight", "none"], translate="false").toPandas()
    assert (got.height[:500] == n).all() and (got.weight[:500] == 3 * n).all() and got.height.isna()[500] and got.none.isna().all()
    out = las.LasStream(point_format=6, scale=(0.01,) * 3)
    for k in range(5):
        out.add(n + 500 * k, n, n, flags=np.full(500, 1 + k % 2))
    h = out.finish(f"{tmp_path}/three.las")
    assert (h.n_points, h.high[0], out.returns.tolist()) == (2500, 2499.0, [0, 1500, 1000, 0, 0, 0])
    assert las.read_las(spark, f"{tmp_path}/three.las", batch="700", translate="false").agg(F.sum("x")).first()[0] == pytest.approx(sum(range(2500)))


def test_tiles_and_long_intervals(spark):
    grid = si.Grid(0.0, 0.0, 1.0, 3)
    rows = spark.createDataFrame([(float(x), float(y)) for x in range(8) for y in range(8)], "x double, y double")
    tile = si.level_offset(1) + 2
    got = rows.select("x", "y", si.subtile_index(grid, F.col("x"), F.col("y"), tile, 1).alias("own"), si.cell_index(grid, F.col("x"), F.col("y")).alias("whole")).withColumn("back", si.whole_index(grid, F.col("own"), tile, 1)).collect()
    inside = [r for r in got if r.own is not None]
    assert len(inside) == 16 and all(r.x < 4 and r.y >= 4 and r.back == r.whole for r in inside)
    assert sorted(r.own for r in inside) == list(range(si.level_offset(2), si.level_offset(3)))
    points = spark.createDataFrame([(k,) for k in (0, 5, 10**6, 10**9, 10**12, 10**12 + 9)], "pid long")
    spans = spark.createDataFrame([(4, 6), (10**6, 10**12 + 1), (10**9, 10**9)], "start long, end long")
    assert sorted(r.pid for r in si.points_of(points, spans).collect()) == [5, 10**6, 10**9, 10**12]
    assert si.points_of(points, spans.limit(0)).count() == 0
