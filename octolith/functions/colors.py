"""Colours: red in the lowest octet, then green, blue and alpha."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The palette of levels, packed colours.
SPECTRAL = (0x4F3ED5, 0x436DF4, 0x61AEFD, 0x8BE0FE, 0x98F5E6, 0xA4DDAB, 0xA5C266, 0xBD8832)
BACKGROUND = 0x00332211


def pack_color(r: Column, g: Column, b: Column, a: Column | int = 255) -> Column:
    a = a if isinstance(a, Column) else F.lit(a)
    return r.cast("long") + g.cast("long") * 256 + b.cast("long") * 65536 + a.cast("long") * 16777216


def channel(color: Column, k: int) -> Column:
    return F.shiftright(color, 8 * k).bitwiseAND(F.lit(255))


def narrow_channel(value: Column) -> Column:
    """16-bit channels to 8 bits; 8-bit ones stay."""
    return F.when(value > 255, F.floor(value / 256)).otherwise(value).cast("int")


def lod_color(level: Column) -> Column:
    index = F.least(F.greatest(((F.lit(8) - level) * F.lit(1.8)).cast("int"), F.lit(0)), F.lit(7))
    table = F.array(*[F.lit(c) for c in SPECTRAL])
    return F.element_at(table, index + 1).cast("long")


def node_color(node: Column) -> Column:
    """A colour that tells neighbouring nodes apart, from the node's number."""
    return F.pmod(F.pmod(node, F.lit(127)) * F.lit(123456789), F.lit(1 << 32))


def choose_color(mode: str, color: Column, level: Column, node: Column) -> Column:
    return {"rgb": color, "node": node_color(node), "lod": lod_color(level)}[mode]
