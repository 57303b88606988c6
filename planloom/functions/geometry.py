"""Geometry as column expressions: everything here stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def quaternion_to_matrix(x: Column, y: Column, z: Column, w: Column) -> dict[str, Column]:
    """The rotation matrix r00 to r22 of a quaternion, which is normalised first (null where it has no length)."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    n = F.when(n > 0, n)
    x, y, z, w = x / n, y / n, z / n, w / n
    return {
        "r00": 1 - 2 * (y * y + z * z), "r01": 2 * (x * y - z * w), "r02": 2 * (x * z + y * w),
        "r10": 2 * (x * y + z * w), "r11": 1 - 2 * (x * x + z * z), "r12": 2 * (y * z - x * w),
        "r20": 2 * (x * z - y * w), "r21": 2 * (y * z + x * w), "r22": 1 - 2 * (x * x + y * y),
    }


def rotate(matrix: dict[str, Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return tuple(matrix[f"r{i}0"] * x + matrix[f"r{i}1"] * y + matrix[f"r{i}2"] * z for i in range(3))


def quaternion_product(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """The turn b followed by the turn a, as x, y, z, w."""
    (ax, ay, az, aw), (bx, by, bz, bw) = a, b
    return aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz


def turn_between(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Degrees of the turn from one orientation (a quaternion) to another; null where one has no length. The half angle's sine and cosine both count, so small turns are exact."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    rel = quaternion_product((-a[0], -a[1], -a[2], a[3]), b)
    return F.degrees(2 * F.atan2(F.sqrt(dot(rel[:3], rel[:3])), F.abs(rel[3]))) * F.when(size > 0, F.lit(1.0))


def back_project(row: Column, col: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """Camera coordinates (x right, y down, z forward) of a pixel's centre."""
    return (col + 0.5 - cx) / fx * depth, (row + 0.5 - cy) / fy * depth, depth


def rotate_about_vertical(x: Column, z: Column, degrees: Column) -> tuple[Column, Column]:
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return c * x + s * z, c * z - s * x


def turn_and_shift(x: Column, z: Column, px: Column, pz: Column, degrees: Column, dx: Column, dz: Column) -> tuple[Column, Column]:
    """Turns about a pivot, the other way round than ``rotate_about_vertical``, then shifts."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return px + c * (x - px) - s * (z - pz) + dx, pz + s * (x - px) + c * (z - pz) + dz


def quarter_turn(x: Column, z: Column, k: Column) -> tuple[Column, Column]:
    """(x, z) -> (-z, x), k times."""
    k = F.pmod(k, F.lit(4))
    return F.when(k == 0, x).when(k == 1, -z).when(k == 2, -x).otherwise(z), F.when(k == 0, z).when(k == 1, x).when(k == 2, -z).otherwise(-x)


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def angle(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Degrees between two vectors; null where one has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(size > 0, size)))))


def rotation_between(a: tuple[Column, ...], b: tuple[Column, ...]) -> dict[str, Column]:
    """The rotation that takes direction a onto b, by their cross product v and cosine c: I + [v] + [v]^2 / (1 + c).

    For parallel vectors that is the identity, for opposite ones its negative.
    """
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    a, b = tuple(x / na for x in a), tuple(x / nb for x in b)
    v, c = cross(a, b), dot(a, b)
    flat = dot(v, v) < 1e-18
    k = 1 / F.when(flat, F.lit(1.0)).otherwise(1 + c)
    skew = ((F.lit(0.0), -v[2], v[1]), (v[2], F.lit(0.0), -v[0]), (-v[1], v[0], F.lit(0.0)))
    out = {}
    for i in range(3):
        for j in range(3):
            square = v[i] * v[j] - (dot(v, v) if i == j else F.lit(0.0))
            full = F.lit(float(i == j)) + skew[i][j] + square * k
            out[f"r{i}{j}"] = F.when(flat, F.lit(float(i == j)) * F.signum(c)).otherwise(full)
    return out


def exif_focal(focal35: Column, width: Column, height: Column, diagonal: float = 43.27) -> Column:
    """Focal length in pixels from its equivalent for a full-frame picture."""
    return focal35 * F.hypot(width.cast("double"), height.cast("double")) / diagonal


def wall_sigma(points: Column, surface: float = 0.005, reach: float = 0.03) -> Column:
    """Standard error of a wall's position from its number of points."""
    return F.hypot(F.lit(surface), F.lit(reach / math.sqrt(3)) / F.sqrt(points.cast("double")))


def measure(value: Column, pm95: Column, note: Column | None = None) -> Column:
    """A measured value with its 95 % range, rounded to millimetres; a null value is unmeasured."""
    return F.struct(F.round(value, 3).alias("value"), F.round(pm95, 3).alias("pm95"), (F.lit(None).cast("string") if note is None else note).alias("note"))


def widen(value: Column, pm95: Column, relative: float, power: int = 1) -> Column:
    """A range with a common scale error added; areas have power 2."""
    return F.hypot(pm95, 2 * power * relative * F.abs(value))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of boxes (x0, y0, x1, y1) over their union."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = size(a) + size(b) - w * h
    return F.coalesce(w * h / F.when(union > 0, union), F.lit(0.0))
