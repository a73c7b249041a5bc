"""Between stored integers and coordinates, and the fields of point records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dequantize(stored: Column, scale: float, offset: float, translation: float = 0.0) -> Column:
    return stored.cast("double") * F.lit(scale) + F.lit(offset) + F.lit(translation)


def _steps(value: Column, scale: float, offset: float) -> Column:
    """In doubles; the integer part is the nearest integer, halves away from zero."""
    v = (value - F.lit(offset)) / F.lit(scale)
    return v + F.when(v >= 0, 0.5).otherwise(-0.5)


def quantize(value: Column, scale: float, offset: float) -> Column:
    """To the nearest integer, halves away from zero."""
    return _steps(value, scale, offset).cast("long")


def overflows(low: Column, high: Column, scale: float, offset: float) -> Column:
    """Whether a box leaves the 32-bit integers when quantized, however far: the sign that a wrapped bound has says nothing after a whole turn."""
    half = float(1 << 31)

    def outside(v: Column) -> Column:
        q = _steps(v, scale, offset)
        return (q >= half) | (q <= -half - 1)

    return outside(low) | outside(high)


def auto_offset(low: Column, high: Column, scale: float) -> Column:
    """The middle of the range, down to a multiple of ten million steps."""
    middle = (low + high) / F.lit(2.0)
    return F.floor(middle / F.lit(scale) / F.lit(1e7)) * F.lit(1e7) * F.lit(scale)


def bits(value: Column, first: int, count: int) -> Column:
    return F.shiftright(value, first).bitwiseAND(F.lit((1 << count) - 1))


def legacy_flags(flags: Column, classification: Column) -> dict[str, Column]:
    """Bit fields of point formats 0 to 5."""
    return {
        "return_number": bits(flags, 0, 3), "number_of_returns": bits(flags, 3, 3), "scan_direction": bits(flags, 6, 1), "edge_of_flight_line": bits(flags, 7, 1),
        "classification": bits(classification, 0, 5), "synthetic": bits(classification, 5, 1), "keypoint": bits(classification, 6, 1), "withheld": bits(classification, 7, 1),
    }


def extended_flags(returns: Column, flags: Column) -> dict[str, Column]:
    """Bit fields of point formats 6 to 10."""
    return {
        "return_number": bits(returns, 0, 4), "number_of_returns": bits(returns, 4, 4), "synthetic": bits(flags, 0, 1), "keypoint": bits(flags, 1, 1), "withheld": bits(flags, 2, 1), "overlap": bits(flags, 3, 1),
        "scanner_channel": bits(flags, 4, 2), "scan_direction": bits(flags, 6, 1), "edge_of_flight_line": bits(flags, 7, 1),
    }
