"""Matrices, frustums and cameras: plain numbers on the driver, literals in the plan."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from octolith.config import Matrix

Planes = list[tuple[float, float, float, float]]


def transpose(m: Matrix) -> Matrix:
    return tuple(tuple(m[j][i] for j in range(4)) for i in range(4))


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def inverse(m: Matrix) -> Matrix:
    """Gauss-Jordan with pivoting."""
    rows = [[float(x) for x in r] + [1.0 if i == j else 0.0 for j in range(4)] for i, r in enumerate(m)]
    for c in range(4):
        pivot = max(range(c, 4), key=lambda r: abs(rows[r][c]))
        if rows[pivot][c] == 0:
            raise ValueError("the matrix has no inverse")
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(4):
            if r != c:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return tuple(tuple(r[4:]) for r in rows)


def apply(m: Matrix, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column, Column]:
    """m * (x, y, z, 1)."""
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in m)


def apply_numbers(m: Matrix, p: Sequence[float]) -> tuple[float, ...]:
    return tuple(sum(a * b for a, b in zip(r, (*p, 1.0), strict=True)) for r in m)


def frustum_planes(m: Matrix) -> Planes:
    """Six planes (normal of length 1, constant), pointing inwards: w -+ x, w +- y, w -+ z."""
    out = []
    for axis, sign in ((0, -1), (0, 1), (1, 1), (1, -1), (2, -1), (2, 1)):
        n = [m[3][k] + sign * m[axis][k] for k in range(4)]
        size = math.sqrt(n[0] ** 2 + n[1] ** 2 + n[2] ** 2)
        out.append(tuple(x / size for x in n) if size else (0.0, 0.0, 0.0, math.inf if n[3] >= 0 else -math.inf))
    return out


def box_in_frustum(planes: Planes, low: Sequence[Column], high: Sequence[Column]) -> Column:
    """No plane has the whole box outside: its corner farthest along the normal is inside."""
    inside = F.lit(True)
    for *normal, constant in planes:
        if not any(normal):
            inside = inside & F.lit(constant > 0)
            continue
        corner = [high[k] if normal[k] > 0 else low[k] for k in range(3)]
        inside = inside & (F.lit(normal[0]) * corner[0] + F.lit(normal[1]) * corner[1] + F.lit(normal[2]) * corner[2] + F.lit(constant) >= 0)
    return inside


def point_in_frustum(planes: Planes, p: Sequence[Column]) -> Column:
    return box_in_frustum(planes, p, p)


def perspective(fovy_degrees: float = 60.0, aspect: float = 1.0, near: float = 0.1, far: float = 2_000_000.0) -> Matrix:
    f = 1 / math.tan(math.radians(fovy_degrees) / 2)
    return ((f / aspect, 0, 0, 0), (0, f, 0, 0), (0, 0, (far + near) / (near - far), 2 * far * near / (near - far)), (0, 0, -1.0, 0))


def _rotation(axis: int, angle: float) -> Matrix:
    c, s = math.cos(angle), math.sin(angle)
    i, j = [(1, 2), (2, 0), (0, 1)][axis]
    m = [[1.0 if r == k else 0.0 for k in range(4)] for r in range(4)]
    m[i][i], m[i][j], m[j][i], m[j][j] = c, -s, s, c
    return tuple(map(tuple, m))


def translation(x: float, y: float, z: float) -> Matrix:
    return ((1.0, 0, 0, x), (0, 1.0, 0, y), (0, 0, 1.0, z), (0, 0, 0, 1.0))


def orbit_world(yaw: float, pitch: float, radius: float, target: Sequence[float]) -> Matrix:
    """Camera-to-world matrix of an orbit around a target in a world whose z points up."""
    m = multiply(translation(*target), _rotation(2, yaw))
    m = multiply(m, _rotation(0, pitch))
    upright: Matrix = ((1.0, 0, 0, 0), (0, 0, -1.0, 0), (0, 1.0, 0, 0), (0, 0, 0, 1.0))
    return multiply(multiply(m, upright), translation(0, 0, radius))


def orbit_view(yaw: float, pitch: float, radius: float, target: Sequence[float], **lens: float) -> Matrix:
    """World-to-clip matrix."""
    return multiply(perspective(**lens), inverse(orbit_world(yaw, pitch, radius, target)))


#: Named views, as (yaw, pitch, radius, target).
PRESETS = {
    "Chiller - bird": (-5.237, -0.542, 34.626, (9.595, 10.394, 0.295)),
    "Chiller - close": (-5.752, 0.090, 16.153, (11.035, 13.285, 2.828)),
    "Retz - bird": (-1.808, -0.997, 1166.684, (691.401, 884.472, -80.610)),
    "Retz - close": (0.750, -0.418, 80.902, (572.854, 856.372, 52.416)),
    "Morro Bay - bird": (-0.207, -0.797, 3866.886, (2398.747, 2167.120, -394.165)),
    "Morro Bay - close": (-11.270, -0.225, 93.982, (2750.218, 974.775, 76.230)),
    "Meroe - bird": (-7.430, -0.617, 929.239, (480.880, 573.485, -15.254)),
    "Meroe - close": (-4.527, -0.192, 44.011, (343.652, 800.906, 18.330)),
    "Endeavor - bird": (-6.045, -0.713, 187.827, (597.671, 602.508, 493.795)),
    "Endeavor - close": (-12.560, -0.018, 8.087, (600.751, 605.780, 508.563)),
}


def preset(name: str, **lens: float) -> Matrix:
    """World-to-clip matrix of a named view."""
    yaw, pitch, radius, target = PRESETS[name]
    return orbit_view(yaw, pitch, radius, target, **lens)


def eye_of(name: str) -> tuple[float, ...]:
    """Where the eye of a named view is."""
    yaw, pitch, radius, target = PRESETS[name]
    return apply_numbers(orbit_world(yaw, pitch, radius, target), (0.0, 0.0, 0.0))[:3]
