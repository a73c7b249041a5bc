"""Choosing a reader by suffix, planning batches, bounds over files, meshes and images."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octolith.config import Cube
from octolith.sources import las, xyzrgba

#: Suffix (lower case) to reader.
READERS = {".las": las.read_las, ".laz": las.read_las, ".xyzrgba": xyzrgba.read_xyzrgba}
COMMON = ("pid", "x", "y", "z", "r", "g", "b", "a")


def register_suffix(name: str, like: str = ".xyzrgba") -> None:
    """Reads files of another suffix as those of a known one: converters name the 16-octet format in their own ways."""
    READERS[name.lower()] = READERS[like]


def suffix(path: str) -> str:
    return os.path.splitext(path)[1].lower()


def existing(paths: Sequence[str]) -> list[str]:
    """Files that can be read, in the order given; missing ones and other suffixes are skipped."""
    return [p for p in paths if suffix(p) in READERS and ("://" in p or os.path.exists(p))]


def file_table(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, n_points, min_x.., max_x..): one row per file, from the headers alone."""
    rows = []
    for p in existing(paths):
        if suffix(p) in (".las", ".laz"):
            h = las.read_header(p)
            rows.append((p, h.n_points, *h.low, *h.high))
        else:
            low, high, n = xyzrgba.read_box(p)
            rows.append((p, n, *low, *high))
    names = [f"{m}_{a} double" for m in ("min", "max") for a in "xyz"]
    return spark.createDataFrame(rows, "path string, n_points long, " + ", ".join(names))


def bounds(files: DataFrame) -> DataFrame:
    """Totals and the box around all files (or all points, given as boxes)."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_points").alias("n_points"), *[F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"], *[F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"])


def cube_of(box) -> Cube:
    """The tree's cube for a row of ``bounds``; points are moved to the origin."""
    return Cube.around((0.0, 0.0, 0.0), tuple(box[f"max_{a}"] - box[f"min_{a}"] for a in "xyz"))


def meets_box(low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Files whose box isn't disjoint from a rectangle: the others need not be opened."""
    return ~((F.col("min_x") >= high[0]) | (F.col("max_x") < low[0]) | (F.col("min_y") >= high[1]) | (F.col("max_y") < low[1]))


def read_points(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    """(pid, x, y, z, r, g, b, a) of all files; pid runs on from file to file.  One scan per kind of file, however many files there are."""
    found = file_table(spark, paths).collect()  # one row per file
    low = ",".join(repr(min(getattr(r, f"min_{a}") for r in found)) for a in "xyz") if found else ""
    by, at = {}, 0
    for r in found:
        some = by.setdefault(READERS[suffix(r.path)], ([], []))
        some[0].append(r.path), some[1].append(str(at))
        at += r.n_points
    out = None
    for reader, (these, starts) in by.items():
        rows = reader(spark, *these, starts=",".join(starts), low=low, **options).select(*COMMON)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "pid long, x double, y double, z double, r int, g int, b int, a int")


def batch_plan(files: DataFrame, size: int = las.BATCH) -> DataFrame:
    """(path, first, count): files in batches of up to ``size`` points."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1, F.lit(size).cast("long"))).alias("first")
    return files.filter("n_points > 0").select("path", "n_points", starts).select("path", "first", F.least(F.col("n_points") - F.col("first"), F.lit(size)).alias("count"))


def within_budget(points: DataFrame, max_points: int) -> DataFrame:
    """The first points by pid; what is left out is never silent: compare the counts."""
    return points.filter(F.col("pid") < max_points)


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """(face, corner, x, y, z, u, v): triangles of a mesh of ``v``, ``vt`` and ``f a/b`` lines, numbered from 1.

    Lines are read in splits of the file and numbered by their place: each split on its own, from how many of a kind the splits before it hold.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    parts = lines.select("block", "line", F.split(F.trim(F.regexp_replace("value", "\r$", "")), r"\s+").alias("w")).withColumn("kind", F.col("w")[0]).filter(F.col("kind").isin("v", "vt", "f"))
    counts = parts.groupBy("kind", "block").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("kind").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("kind").alias("_kind"), F.col("block").alias("_block"), before.alias("start"))
    place = F.row_number().over(Window.partitionBy("kind", "block").orderBy("line"))
    numbered = parts.withColumn("place", place).join(starts, (F.col("kind") == F.col("_kind")) & (F.col("block") == F.col("_block"))).withColumn("n", F.col("start") + F.col("place"))
    v = numbered.filter("kind = 'v'").select(F.col("n").alias("vn"), *[F.get("w", F.lit(k + 1)).cast("double").alias(a) for k, a in enumerate("xyz")])
    t = numbered.filter("kind = 'vt'").select(F.col("n").alias("tn"), *[F.get("w", F.lit(k + 1)).cast("double").alias(a) for k, a in enumerate("uv")])
    f = numbered.filter("kind = 'f'").select((F.col("n") - 1).alias("face"), F.posexplode(F.slice("w", 2, 3)).alias("corner", "c"))
    f = f.select("face", "corner", F.split("c", "/")[0].cast("int").alias("vi"), F.get(F.split("c", "/"), F.lit(1)).alias("ti"))
    f = f.withColumn("ti", F.nullif("ti", F.lit("")).cast("int"))
    return f.join(v, f.vi == v.vn).join(t, f.ti == t.tn, "left").select("face", "corner", "x", "y", "z", "u", "v")


def write_ppm(image: DataFrame, path: str, width: int, height: int) -> None:
    """A picture file of an image (bounded by the viewport): rows from the top."""
    canvas = bytearray(3 * width * height)
    for px, py, color in image.select("px", "py", "color").toLocalIterator():
        at = 3 * (px + width * (height - 1 - py))
        canvas[at : at + 3] = int(color).to_bytes(8, "little")[:3]
    store, place = las.store_of(path)
    store.create_dir(os.path.dirname(place), recursive=True)
    with store.open_output_stream(place, compression=None) as file:
        file.write(f"P6 {width} {height} 255\n".encode() + bytes(canvas))
