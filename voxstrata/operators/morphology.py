"""Erosion, dilation, distances, gradients and rasterising over sparse voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES, ball, offsets, shifted


def inside(side: int, prefix: str = ""):
    out = F.lit(True)
    for a in AXES:
        out = out & (F.col(prefix + a) >= 0) & (F.col(prefix + a) < side)
    return out


def erode(labelled: DataFrame, side: int, steps: int = 1, connectivity: int = 6) -> DataFrame:
    """x, y, z, label of voxels whose neighbours all have their label, `steps` times; places outside the grid count as equal."""
    offs = offsets(1, connectivity)
    for _ in range(steps):
        asked = shifted(labelled.select(*AXES, "label"), offs, keep=("from",))
        met = asked.join(labelled.select(*AXES, "label"), [*AXES, "label"], "left_semi").select("from_x", "from_y", "from_z")
        beyond = asked.where(~inside(side)).select("from_x", "from_y", "from_z")
        whole = met.unionByName(beyond).groupBy("from_x", "from_y", "from_z").agg(F.count("*").alias("n")).where(F.col("n") == len(offs))
        labelled = labelled.join(whole.select(*[F.col(f"from_{a}").alias(a) for a in AXES]), list(AXES), "left_semi")
    return labelled


def dilate(foreground: DataFrame, radius: float, side: int, voxel_size=(1, 1, 1)) -> DataFrame:
    """Places within a physical radius of the foreground."""
    return shifted(foreground.select(*AXES), ball(radius, voxel_size)).where(inside(side)).distinct()


def ring(foreground: DataFrame, radius: float, side: int) -> DataFrame:
    """The dilated places that weren't foreground."""
    return dilate(foreground, radius, side).join(foreground.select(*AXES), list(AXES), "left_anti")


def distances(foreground: DataFrame, radius: float, side: int) -> DataFrame:
    """x, y, z, d2: squared distance to the nearest foreground voxel, for places within radius."""
    moved = shifted(foreground.select(*AXES), ball(radius), keep=("offset",)).where(inside(side))
    o = F.col("offset")
    return moved.groupBy(*AXES).agg(F.min(o["dx"] * o["dx"] + o["dy"] * o["dy"] + o["dz"] * o["dz"]).alias("d2"))


def gradient(d: DataFrame) -> DataFrame:
    """Central differences of a value v along each axis where both neighbours exist."""
    out = d.select(*AXES)
    for a in AXES:
        up = d.select(*[(F.col(b) - 1).alias(b) if b == a else F.col(b) for b in AXES], F.col("v").alias("up"))
        down = d.select(*[(F.col(b) + 1).alias(b) if b == a else F.col(b) for b in AXES], F.col("v").alias("down"))
        out = out.join(up.join(down, list(AXES)).select(*AXES, ((F.col("up") - F.col("down")) / 2).alias(f"g{a}")), list(AXES))
    return out


def rasterize(nodes: DataFrame, edges: DataFrame, radius: float, side: int) -> DataFrame:
    """x, y, z, id: edges drawn as lines (as many steps as their longest axis), grown by radius; the smallest node id wins."""
    a, b = nodes.select(*[F.col(c).alias(f"a_{c}") for c in ("id", *AXES)]), nodes.select(*[F.col(c).alias(f"b_{c}") for c in ("id", *AXES)])
    lines = edges.select(F.col("u").alias("a_id"), F.col("v").alias("b_id")).join(a, "a_id").join(b, "b_id")
    n = F.greatest(*[F.abs(F.col(f"b_{c}") - F.col(f"a_{c}")) for c in AXES], F.lit(1))
    drawn = lines.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda c: F.floor((2 * F.col(f"a_{c}") * F.col("n") + 2 * (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("t") + F.col("n")) / (2 * F.col("n"))).cast("int").alias(c)
    dots = drawn.select(*[at(c) for c in AXES], F.least("a_id", "b_id").alias("id")).unionByName(nodes.select(*AXES, "id"))
    return shifted(dots, ball(radius)).where(inside(side)).groupBy(*AXES).agg(F.min("id").alias("id"))
