"""Vector arithmetic, strings and number formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, ...]


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(value, low), high)


def smoothstep(low: Column, high: Column, value: Column) -> Column:
    t = clamp((value - low) / (high - low), 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def fract(value: Column) -> Column:
    return value - F.floor(value)


def modulo(a: Column, b: Column) -> Column:
    """Sign of the dividend, as in C."""
    return a % b


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def subtract(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vector, by: Column | float) -> Vector:
    return tuple(x * by for x in a)


def multiply(a: Vector, b: Vector) -> Vector:
    return tuple(x * y for x, y in zip(a, b, strict=True))


def divide(a: Vector, b: Vector) -> Vector:
    return tuple(x / y for x, y in zip(a, b, strict=True))


def random_scalar(key: Column, seed: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) from the first 32 bits of a digest of key and seed: the same for the same row, however rows are dealt."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.lit(low) + bits / F.lit(float(1 << 32)) * F.lit(high - low)


def random_vector(key: Column, size: int = 3, seed: int = 0, low: float = 0.0, high: float = 1.0) -> Vector:
    return tuple(random_scalar(key, seed * size + k, low, high) for k in range(size))


def minimum(a: Vector, b: Vector) -> Vector:
    return tuple(F.least(x, y) for x, y in zip(a, b, strict=True))


def maximum(a: Vector, b: Vector) -> Vector:
    return tuple(F.greatest(x, y) for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def inverse_sqrt(value: Column) -> Column:
    return F.lit(1.0) / F.sqrt(value)


def normalize(a: Vector) -> Vector:
    return scale(a, inverse_sqrt(dot(a, a)))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def reflect(incident: Vector, normal: Vector) -> Vector:
    return subtract(incident, scale(scale(normal, dot(normal, incident)), 2.0))


def distance_to_plane(normal: Vector, constant: Column, point: Vector) -> Column:
    return dot(normal, point) + constant


def ray_to_plane(origin: Vector, direction: Vector, normal: Vector, constant: Column) -> Column:
    """Distance along a ray to a plane that it meets from outside; 0 for a ray in the plane, else null."""
    slope, away = dot(normal, direction), distance_to_plane(normal, constant, origin)
    t = -away / F.nullif(slope, F.lit(0.0))
    return F.when(slope == 0, F.when(away == 0, F.lit(0.0))).otherwise(F.when((slope > 0) & (t >= 0), t))


def replace_first(text: Column, what: str, by: str) -> Column:
    at = F.instr(text, what)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(by), F.substr(text, at + len(what)))).otherwise(text)


def equals_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def ends_with_ignoring_case(text: Column, suffix: str) -> Column:
    return F.endswith(F.lower(text), F.lit(suffix.lower()))


def pad_left(text: Column, size: int, fill: str = " ") -> Column:
    """Never cuts (unlike lpad)."""
    return F.concat(F.repeat(F.lit(fill), F.greatest(F.lit(size) - F.length(text), F.lit(0))), text)


def pad_right(text: Column, size: int, fill: str = " ") -> Column:
    return F.concat(text, F.repeat(F.lit(fill), F.greatest(F.lit(size) - F.length(text), F.lit(0))))


def split_text(text: Column, mark: str) -> Column:
    """Parts between marks; an empty part at the end doesn't count."""
    parts = F.split(text, "\\Q" + mark + "\\E")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def format_thousands(value: Column, decimals: int = 0) -> Column:
    return F.translate(F.format_number(value, decimals), ",", "'")
