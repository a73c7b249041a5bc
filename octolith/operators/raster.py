"""Images as aggregations: a pixel is a group, its colour an aggregate of the samples that fall into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from octolith.config import Cube, Matrix, View
from octolith.functions.camera import apply, apply_numbers, frustum_planes, inverse, point_in_frustum
from octolith.functions.colors import BACKGROUND, channel, choose_color, pack_color
from octolith.functions.lattice import AXES, morton, node_id, settled
from octolith.functions.scalars import ray_to_plane

HQS_DEPTH = 1.01
EDL_STRENGTH, EDL_NORM = 0.4, 50.0
LINE_STEPS = 400
PIXEL = ("px", "py")


def project(samples: DataFrame, view: View) -> DataFrame:
    """Adds px, py (whole pixels) and depth to samples in front of the eye and inside a border of two pixels."""
    x, y, _, w = apply(view.transform, F.col("x"), F.col("y"), F.col("z"))
    rows = settled(samples, _x=x, _y=y, depth=w).filter("depth > 0")
    px = ((F.col("_x") / F.col("depth")) * F.lit(0.5) + F.lit(0.5)) * F.lit(float(view.width))
    py = ((F.col("_y") / F.col("depth")) * F.lit(0.5) + F.lit(0.5)) * F.lit(float(view.height))
    rows = settled(rows, _x=px, _y=py)
    # the test first, as numbers: a cast of what lies far outside would not fit
    near = (F.col("_x") >= 2) & (F.col("_x") < view.width - 2) & (F.col("_y") >= 2) & (F.col("_y") < view.height - 2)
    return rows.filter(near).withColumns({"px": F.col("_x").cast("int"), "py": F.col("_y").cast("int")}).drop("_x", "_y")


def fragments(samples: DataFrame, view: View) -> DataFrame:
    """(px, py, depth, color): each sample covers point_size^2 pixels."""
    mode = view.color_mode
    number = F.lit(0).cast("long") if mode != "node" else node_id(F.col("level"), morton(F.col("nx"), F.col("ny"), F.col("nz")))
    level = F.col("level") if mode == "lod" else F.lit(0)
    rows = project(samples, view).select(*PIXEL, "depth", choose_color(mode, F.col("color"), level, number).alias("color"))
    if view.point_size == 1:
        return rows
    offsets = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(view.point_size) for y in range(view.point_size)])).alias("o")
    rows = rows.select("*", offsets)
    return rows.select(F.least(F.col("px") + F.col("o.x"), F.lit(view.width - 1)).alias("px"), F.least(F.col("py") + F.col("o.y"), F.lit(view.height - 1)).alias("py"), "depth", "color")


def nearest(frags: DataFrame) -> DataFrame:
    """The nearest fragment of each pixel; of equally near ones the smallest colour."""
    return frags.groupBy(*PIXEL).agg(F.min(F.struct("depth", "color")).alias("f")).select(*PIXEL, "f.depth", "f.color")


def min_depth(frags: DataFrame) -> DataFrame:
    return frags.groupBy(*PIXEL).agg(F.min("depth").alias("depth"))


def blended(frags: DataFrame) -> DataFrame:
    """(px, py, depth, color): mean colour of the fragments within 1 % of the nearest one."""
    front = min_depth(frags).select(F.col("px").alias("_x"), F.col("py").alias("_y"), F.col("depth").alias("_d"))
    close = frags.join(front, (F.col("px") == F.col("_x")) & (F.col("py") == F.col("_y")) & (F.col("depth") < F.col("_d") * HQS_DEPTH))
    sums = close.groupBy(*PIXEL).agg(F.min("_d").alias("depth"), F.count(F.lit(1)).alias("n"), *[F.sum(channel(F.col("color"), k)).alias(f"s{k}") for k in range(3)])
    return sums.select(*PIXEL, "depth", pack_color(*[F.floor(F.col(f"s{k}") / F.col("n")) for k in range(3)]).alias("color"))


def clear(spark: SparkSession, view: View) -> DataFrame:
    """Every pixel with the background's colour and infinite depth."""
    n = spark.range(view.width * view.height)
    return n.select((F.col("id") % view.width).cast("int").alias("px"), F.floor(F.col("id") / view.width).cast("int").alias("py"), F.lit(float("inf")).alias("depth"), F.lit(BACKGROUND).cast("long").alias("color"))


def filled(image: DataFrame, view: View) -> DataFrame:
    """The image over the cleared one: both in one aggregation."""
    return nearest(image.select(*PIXEL, "depth", "color").unionByName(clear(image.sparkSession, view)))


def shaded(image: DataFrame, view: View, strength: float = EDL_STRENGTH, norm: float = EDL_NORM) -> DataFrame:
    """Depth edges: a pixel darkens by how far its four neighbours lie in front of it.  ``image`` has every pixel.

    Each pixel sends its depth to its neighbours; they meet in one aggregation.  Neighbours count along
    the rows' sequence, so a row's end is next to the next row's start, and the image's ends are their own neighbours.
    """
    last = view.width * view.height - 1
    at = F.col("px") + F.col("py") * view.width
    rows = image.select(at.alias("at"), F.log2("depth").alias("own"), "color")
    sent = [F.struct(F.greatest(F.lit(0), F.least(F.lit(last), F.col("at") + d)).alias("to"), F.col("at").alias("from")) for d in (1, -1, view.width, -view.width)]
    asks = rows.select("own", F.col("at").alias("asker"), "color", F.explode(F.array(*sent)).alias("x")).select("asker", "own", "color", F.col("x.to").alias("to"))
    there = rows.select(F.col("at").alias("_at"), F.col("own").alias("other"))
    gap = F.when(F.col("own") == F.col("other"), 0.0).otherwise(F.greatest(F.col("own") - F.col("other"), F.lit(0.0)))
    sums = asks.join(there, F.col("to") == F.col("_at")).groupBy("asker").agg(F.sum(gap).alias("sum"), F.first("color").alias("color"))
    shade = F.exp(-(F.col("sum") / norm) * 300.0 * strength)
    color = pack_color(*[(shade * channel(F.col("color"), k)).cast("int") for k in range(3)])
    return sums.select((F.col("asker") % view.width).cast("int").alias("px"), F.floor(F.col("asker") / view.width).cast("int").alias("py"), color.alias("color"))


def frustum_lines(view: View, far: float = 0.99995) -> list[tuple[tuple[float, ...], tuple[float, ...]]]:
    """Eight lines of a frustum: four edges towards the eye and the far side, in world coordinates."""
    back = inverse(view.update_transform)

    def world(p: tuple[float, float, float]) -> tuple[float, ...]:
        x, y, z, w = apply_numbers(back, p)
        return x / w, y / w, z / w

    corners = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    edges = [((x, y, -1.0), (x, y, far)) for x, y in corners]
    edges += [((-1, y, far), (1, y, far)) for y in (-1, 1)] + [((x, -1, far), (x, 1, far)) for x in (-1, 1)]
    return [(world(a), world(b)) for a, b in edges]


def _clipped(rows: DataFrame, end: str, sign: float, transform: Matrix) -> DataFrame:
    """Moves a line's end (columns ``end``x..) that is outside the frustum to where its ray (the line's direction times ``sign``) enters the last plane that it meets."""
    planes = frustum_planes(transform)
    p, d = tuple(F.col(f"{end}{n}") for n in AXES), tuple(F.col(f"_d{n}") * F.lit(sign) for n in AXES)
    hits = {f"_t{k}": F.coalesce(ray_to_plane(p, d, tuple(F.lit(x) for x in plane[:3]), F.lit(plane[3])), F.lit(0.0)) for k, plane in enumerate(planes)}
    rows = settled(rows, **hits)
    rows = settled(rows, _t=F.when(point_in_frustum(planes, p), 0.0).otherwise(F.greatest(*hits)))
    return settled(rows, **{f"{end}{n}": a + F.col("_t") * b for n, a, b in zip(AXES, p, d, strict=True)})


def line_fragments(lines: DataFrame, view: View) -> DataFrame:
    """(px, py, depth, color) along lines (x0, y0, z0, x1, y1, z1, color), clipped, up to LINE_STEPS steps each."""
    rows = settled(lines, **{f"{p}{n}": F.col(f"{n}{k}") for k, p in enumerate("se") for n in AXES})
    rows = settled(rows, _s=F.sqrt(sum(((F.col(f"e{n}") - F.col(f"s{n}")) * (F.col(f"e{n}") - F.col(f"s{n}")) for n in AXES), F.lit(0.0)))).filter("_s > 0")
    rows = settled(rows, **{f"_d{n}": (F.col(f"e{n}") - F.col(f"s{n}")) / F.col("_s") for n in AXES})
    rows = _clipped(_clipped(rows, "s", 1.0, view.transform), "e", -1.0, view.transform)
    for p in "se":
        x, y, _, w = apply(view.transform, *[F.col(f"{p}{n}") for n in AXES])
        rows = settled(rows, **{f"{p}_u": x, f"{p}_v": y, f"{p}w": w}).filter(F.col(f"{p}w") != 0)
        rows = settled(rows, **{f"{p}_u": F.col(f"{p}_u") / F.col(f"{p}w"), f"{p}_v": F.col(f"{p}_v") / F.col(f"{p}w")})
    dx, dy = (F.col("e_u") - F.col("s_u")) * (0.5 * view.width), (F.col("e_v") - F.col("s_v")) * (0.5 * view.height)
    steps = F.ceil(F.least(F.sqrt(dx * dx + dy * dy), F.lit(float(LINE_STEPS)))).cast("int")
    rows = settled(rows, _n=steps).filter("_n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_n"))).alias("k"))
    u = F.col("k") / F.col("_n")

    def along(p: str) -> Column:
        return (F.lit(1.0) - u) * F.col(f"s{p}") + u * F.col(f"e{p}")

    rows = rows.select(along("_u").alias("X"), along("_v").alias("Y"), along("w").alias("depth"), F.col("color").cast("long").alias("color")).filter("abs(X) <= 1 AND abs(Y) <= 1 AND depth > 0")
    px, py = (F.greatest(F.lit(0), F.least(F.lit(n - 1), ((F.col(c) * 0.5 + 0.5) * n).cast("int"))) for c, n in (("X", view.width), ("Y", view.height)))
    return rows.select(px.alias("px"), py.alias("py"), "depth", "color")
