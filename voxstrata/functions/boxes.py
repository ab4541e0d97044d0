"""Box predicates and grid expressions.

Three conventions meet here: regions of interest are half-open, skeleton queries
use closed boxes, and the legacy point filter an open one.  All take bounds in
(x, y, z) order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def half_open(lo, hi, prefix: str = "") -> Column:
    """lo <= c < hi on each axis; a bound of None is no bound."""
    out = [F.lit(True)]
    for a, low, high in zip(AXES, lo, hi):
        out += [] if low is None else [F.col(prefix + a) >= low]
        out += [] if high is None else [F.col(prefix + a) < high]
    return all_of(out)


def closed(lo, hi, prefix: str = "") -> Column:
    return all_of(F.col(prefix + a).between(low, high) for a, low, high in zip(AXES, lo, hi))


def open_box(lo, hi, prefix: str = "") -> Column:
    return all_of((F.col(prefix + a) > low) & (F.col(prefix + a) < high) for a, low, high in zip(AXES, lo, hi))


def overlap_closed(a: str, b: str) -> Column:
    """Boxes min_/max_ of two sides overlap or touch."""
    return all_of((F.col(f"{a}min_{x}") <= F.col(f"{b}max_{x}")) & (F.col(f"{b}min_{x}") <= F.col(f"{a}max_{x}")) for x in AXES)


def cell(c: Column | str, size) -> Column:
    """Index of the grid cell that holds a coordinate; floors, also below zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(size)).cast("int")


def squared_distance(a: str, b: str) -> Column:
    """Squared distance of two sides' coordinates; whole numbers stay exact."""
    return reduce(lambda s, t: s + t, [(F.col(a + x) - F.col(b + x)) * (F.col(a + x) - F.col(b + x)) for x in AXES])


def offsets(reach: int, connectivity: int = 26) -> list[tuple[int, int, int]]:
    """Neighbour offsets: connectivity 6, 18 or 26 for a reach of 1, else the whole cube without its centre."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    r = range(-reach, reach + 1)
    return [(i, j, k) for i in r for j in r for k in r if (i, j, k) != (0, 0, 0) and (reach > 1 or abs(i) + abs(j) + abs(k) <= most)]


def ball(radius: float, voxel_size=(1, 1, 1)) -> list[tuple[int, int, int]]:
    """Offsets within a physical radius, the centre included."""
    reach = [int(radius // s) for s in voxel_size]
    return [
        (i, j, k)
        for i in range(-reach[0], reach[0] + 1)
        for j in range(-reach[1], reach[1] + 1)
        for k in range(-reach[2], reach[2] + 1)
        if (i * voxel_size[0]) ** 2 + (j * voxel_size[1]) ** 2 + (k * voxel_size[2]) ** 2 <= radius**2
    ]


def offset_array(offs) -> Column:
    """A constant array of offsets, to explode.  Its size is that of the neighbourhood, not of the data."""
    return F.expr("array(" + ",".join(f"named_struct('dx',{i},'dy',{j},'dz',{k})" for i, j, k in offs) + ")")


def shifted(df, offs, keep=()):
    """A row for each offset, with x, y, z moved by it."""
    rest = [c for c in df.columns if c not in AXES]
    return df.withColumn("o", F.explode(offset_array(offs))).select(*rest, *[(F.col(a) + F.col(f"o.d{a}")).cast("int").alias(a) for a in AXES], *[F.col(a).alias(f"from_{a}") for a in AXES if "from" in keep], *[F.col("o").alias("offset")] * ("offset" in keep))
