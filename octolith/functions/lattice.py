"""The integer lattice: one coordinate of 28 bits per axis gives every node, voxel and parent by shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from octolith.config import LATTICE_BITS, MAX_DEPTH, Cube

AXES = ("x", "y", "z")
LATTICE = ("px", "py", "pz")
NODE = ("level", "nx", "ny", "nz")


def lattice_coordinate(value: Column, low: float, size: float, bits: int = LATTICE_BITS, wrap_max_face: bool = False) -> Column:
    """floor(2^bits * (value - low) / size); the upper face belongs to the last cell (or wraps to the first)."""
    cell = F.floor(F.lit(float(1 << bits)) * (value.cast("double") - F.lit(low)) / F.lit(size))
    if wrap_max_face:
        return F.pmod(cell, F.lit(1 << bits))
    return F.greatest(F.lit(0).cast("long"), F.least(cell, F.lit((1 << bits) - 1)))


def with_lattice(points: DataFrame, cube: Cube, wrap_max_face: bool = False) -> DataFrame:
    """Adds px, py, pz to points with x, y, z."""
    lows = {"x": cube.x, "y": cube.y, "z": cube.z}
    return points.withColumns({f"p{a}": lattice_coordinate(F.col(a), lows[a], cube.size, wrap_max_face=wrap_max_face) for a in AXES})


def shift_right(value: Column, by: int | Column) -> Column:
    """``>>`` by a number or a column of numbers."""
    return F.shiftright(value, by) if isinstance(by, int) else F.call_function("shiftright", value, by.cast("int"))


def node_coordinate(lattice: Column, level: Column | int) -> Column:
    return shift_right(lattice, LATTICE_BITS - level if isinstance(level, int) else F.lit(LATTICE_BITS) - level)


def voxel_coordinate(lattice: Column, level: Column | int, grid_bits: int) -> Column:
    """Global voxel coordinate at a level: the node is its upper part, the voxel in the node its lower ``grid_bits``."""
    free = LATTICE_BITS - grid_bits
    return shift_right(lattice, free - level if isinstance(level, int) else F.lit(free) - level)


def child_index(nx: Column, ny: Column, nz: Column) -> Column:
    """x is the highest bit, z the lowest."""
    one = F.lit(1).cast("long")
    return nx.bitwiseAND(one) * 4 + ny.bitwiseAND(one) * 2 + nz.bitwiseAND(one)


def spread_bits(value: Column, bits: int = 21) -> Column:
    """Puts two zero bits before each bit: groups of bits move apart, half as long each time."""
    out = value.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    for group in (16, 8, 4, 2, 1):
        mask = sum(1 << (i % group + 3 * group * (i // group)) for i in range(bits))
        out = out.bitwiseOR(F.shiftleft(out, 2 * group)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def morton(x: Column, y: Column, z: Column, bits: int = 21) -> Column:
    """Z-order code; x leads, so that three bits are a child index."""
    return F.shiftleft(spread_bits(x, bits), 2).bitwiseOR(F.shiftleft(spread_bits(y, bits), 1)).bitwiseOR(spread_bits(z, bits))


def node_name(level: Column, code: Column) -> Column:
    """``r`` and one octal digit per level, from the Morton code of the node's coordinates."""
    digits = F.lpad(F.conv(code.cast("string"), 10, 8), MAX_DEPTH + 1, "0")
    return F.concat(F.lit("r"), F.when(level > 0, F.right(digits, level)).otherwise(F.lit("")))


def node_id(level: Column, code: Column) -> Column:
    """Unique number of a node: its Morton code below a leading one."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (level * 3).cast("int")).bitwiseOR(code)


def explode_levels(points: DataFrame, first: int, last: int, *keep: str) -> DataFrame:
    """One row per point and level, with the node that holds the point there."""
    levels = F.explode(F.array(*[F.lit(k) for k in range(first, last + 1)])).alias("level")
    rows = points.select(*keep, *LATTICE, levels)
    return rows.withColumns({f"n{a}": node_coordinate(F.col(f"p{a}"), F.col("level")) for a in AXES})


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read instead of repeating: the optimizer would inline them, and code grow with each use."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, made).select(*kept, *[F.col(f"_settled.{n}").alias(n) for n in columns])
