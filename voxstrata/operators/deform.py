"""Elastic deformation: a coarse control grid gives every place the place that its value is taken from.

A map is rows (x, y, z, sx, sy, sz): the value at x, y, z comes from sx, sy, sz.  Offsets
of the control points are interpolated linearly along each axis; a cell of the control
grid is one row with the offsets at its eight corners, so a place meets one row.  Values
are gathered by an equi-join of the places with the stored voxels around their source,
each with its weight; missing voxels are zeros and add nothing.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxstrata.functions.boxes import AXES, offsets
from voxstrata.operators.spatial import met_in_cells, packed_cells

_CORNERS = list(itertools.product((0, 1), repeat=3))
_CELL = ["ci", "cj", "ck"]


def rotation(angle: float, scale: float = 1.0) -> list[list[float]]:
    """The matrix that turns x and y by an angle and scales all axes."""
    c, s = math.cos(angle) * scale, math.sin(angle) * scale
    return [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, scale]]


def control_cells(control: DataFrame) -> DataFrame:
    """ci, cj, ck and, for each corner n, ox<n>, oy<n>, oz<n>: the cells that control points (i, j, k, ox, oy, oz) are corners of; points that aren't there have no offset."""
    corner = F.explode(F.array(*[F.struct(*[(F.col(c) - d).cast("int").alias(k) for c, d, k in zip(("i", "j", "k"), o, _CELL)], F.lit(n).alias("n")) for n, o in enumerate(_CORNERS)]))
    rows = control.select(corner.alias("c"), "ox", "oy", "oz").select("c.*", "ox", "oy", "oz")
    return rows.groupBy(*_CELL).agg(*[F.coalesce(F.max(F.when(F.col("n") == n, F.col(f"o{a}"))), F.lit(0.0)).alias(f"o{a}{n}") for n in range(8) for a in AXES])


def places(spark: SparkSession, lo, hi) -> DataFrame:
    """x, y, z of every place of a half-open box."""
    n = [h - low for low, h in zip(lo, hi)]
    i = F.col("id")
    at = (F.floor(i / (n[1] * n[2])), F.floor(i / n[2]) % n[1], i % n[2])
    return spark.range(n[0] * n[1] * n[2]).select(*[(c + low).cast("int").alias(a) for c, low, a in zip(at, lo, AXES)])


def coordinate_map(targets: DataFrame, control: DataFrame, spacing, matrix=None, centre=(0.0, 0.0, 0.0)) -> DataFrame:
    """x, y, z, sx, sy, sz of the targets (x, y, z): matrix * (place - centre) + centre, plus the control grid's offset at the place.

    Control point (i, j, k) lies at i, j, k times the spacing."""
    matrix = matrix or [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = targets.select(*AXES, *[F.floor(F.col(a) / s).cast("int").alias(c) for a, s, c in zip(AXES, spacing, _CELL)])
    share = {a: F.col(a) / s - F.col(c) for a, s, c in zip(AXES, spacing, _CELL)}
    weights = []
    for o in _CORNERS:
        w: Column = F.lit(1.0)
        for a, d in zip(AXES, o):
            w = w * (share[a] if d else 1 - share[a])
        weights.append(w)
    met = rows.join(control_cells(control), _CELL, "left")
    moved = lambda a: sum((w * F.coalesce(f"o{a}{n}", F.lit(0.0)) for n, w in enumerate(weights)), F.lit(0.0))
    turned = lambda r: sum(((F.col(a) - c) * m for a, c, m in zip(AXES, centre, matrix[r])), F.lit(centre[r]))
    return met.select(*AXES, *[(turned(r) + moved(a)).alias(f"s{a}") for r, a in enumerate(AXES)])


def misalign(mapping: DataFrame, shifts: DataFrame, lasting: bool = False) -> DataFrame:
    """The map with sources moved within each section by shifts (z, dx, dy); lasting shifts move all later sections too.

    Lasting shifts are summed in one task, a row a section."""
    if lasting:
        so_far = Window.orderBy("z").rowsBetween(Window.unboundedPreceding, 0)
        every = mapping.select("z").distinct().join(shifts, "z", "full").na.fill(0, ["dx", "dy"])
        shifts = every.select("z", *[F.sum(c).over(so_far).alias(c) for c in ("dx", "dy")])
    out = mapping.join(shifts, "z", "left")
    return out.select(*AXES, *[(F.col(f"s{a}") + F.coalesce(f"d{a}", F.lit(0))).alias(f"s{a}") for a in ("x", "y")], "sz")


def gather(voxels: DataFrame, mapping: DataFrame, linear: bool = True) -> DataFrame:
    """x, y, z, v: the value at each place's source, of the eight voxels around it by distance along each axis, or of the nearest one (for labels).

    Places without a stored voxel there get no row."""
    if not linear:
        at = mapping.select(*[F.col(a).alias(f"t{a}") for a in AXES], *[F.floor(F.col(f"s{a}") + 0.5).cast("int").alias(a) for a in AXES])
        return at.join(voxels.select(*AXES, "v"), list(AXES)).select(*[F.col(f"t{a}").alias(a) for a in AXES], "v")
    based = mapping.select(*[F.col(a).alias(f"t{a}") for a in AXES], *[F.floor(f"s{a}").alias(f"b{a}") for a in AXES], *[(F.col(f"s{a}") - F.floor(f"s{a}")).alias(f"f{a}") for a in AXES])
    corners = []
    for o in _CORNERS:
        w: Column = F.lit(1.0)
        for a, d in zip(AXES, o):
            w = w * (F.col(f"f{a}") if d else 1 - F.col(f"f{a}"))
        corners.append(F.struct(*[(F.col(f"b{a}") + d).cast("int").alias(a) for a, d in zip(AXES, o)], w.alias("w")))
    rows = based.select(*[f"t{a}" for a in AXES], F.explode(F.array(*corners)).alias("c")).select(*[f"t{a}" for a in AXES], "c.*").where("w > 0")
    met = rows.join(voxels.select(*AXES, "v"), list(AXES)).groupBy(*[f"t{a}" for a in AXES]).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return met.select(*[F.col(f"t{a}").alias(a) for a in AXES], "v")


def move_points(points: DataFrame, mapping: DataFrame, reach: float) -> DataFrame:
    """id, x, y, z: the place whose source is nearest to each point (id, x, y, z); points without a source within reach get no row.

    Ties, to nine digits, go to the smallest place."""
    axes = [F.col(a).alias(f"p{a}") for a in AXES]
    sources = mapping.select(*[F.col(a).alias(f"t{a}") for a in AXES], *[F.col(f"s{a}").alias(a) for a in AXES])
    asked = points.select(*AXES).distinct().select(*AXES, *axes)  # points at one place have one answer
    cells = lambda df, k: packed_cells(df, reach, df.columns, [], k)
    met = met_in_cells(cells(asked, "a"), cells(sources, "b"), [(0, 0, 0), *offsets(1)])
    d2 = sum(((F.col(f"a_{a}") - F.col(f"b_{a}")) * (F.col(f"a_{a}") - F.col(f"b_{a}")) for a in AXES), F.lit(0.0))
    near = met.where(d2 <= reach * reach + 1e-6).withColumn("d2", F.round(d2, 9)).where(F.col("d2") <= reach * reach)
    best = near.groupBy(*[F.col(f"a_p{a}").alias(a) for a in AXES]).agg(F.min(F.struct("d2", *[F.col(f"b_t{a}").alias(f"t{a}") for a in AXES])).alias("m"))
    return points.select("id", *AXES).join(best.hint("merge"), list(AXES)).select("id", *[F.col(f"m.t{a}").alias(a) for a in AXES])


def deskew(voxels: DataFrame, depth: int, pixel: float = 0.406, angle: float = 32.1, step: float = 2.0, direction: int = -1) -> DataFrame:
    """x, y, z, v of a stack of `depth` sections taken at an angle (degrees): section z is moved along x by z times the step's projection in whole pixels.

    direction 1 goes right to left; with -1 all is moved so that no place is negative."""
    shear = round(direction * math.cos(math.radians(angle)) * step / pixel)
    ahead = -shear * (depth - 1) if shear < 0 else 0
    return voxels.select((F.col("x") + shear * F.col("z") + ahead).cast("int").alias("x"), "y", "z", "v")
