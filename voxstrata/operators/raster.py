"""Graphs drawn into volumes: balls, rings and peaks, inside objects; and radii read from a segmentation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES, ball, cell, half_open, shifted
from voxstrata.functions.shared import materialised
from voxstrata.operators.samples import filled_from_tree


def line_places(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """x, y, z of the places on the lines between the nodes of edges (u, v): as many steps as the longest axis, halves rounded up."""
    at = lambda p: nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", *AXES)])
    lines = edges.select(F.col("u").alias("a_id"), F.col("v").alias("b_id")).join(at("a"), "a_id").join(at("b"), "b_id")
    n = F.greatest(*[F.abs(F.col(f"b_{c}") - F.col(f"a_{c}")) for c in AXES], F.lit(1))
    steps = lines.withColumn("n", n).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n"))))
    return steps.select(*[F.floor((2 * F.col(f"a_{c}") * F.col("n") + 2 * (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("t") + F.col("n")) / (2 * F.col("n"))).cast("int").alias(c) for c in AXES]).distinct()


def draw(nodes: DataFrame, lo, hi, radius: float, edges: DataFrame | None = None, ring: float | None = None, mask: DataFrame | None = None, voxel_size=(1, 1, 1)) -> DataFrame:
    """x, y, z of the places within a physical radius of a node (id, x, y, z) or of a line, in the half-open box.

    ring: only the outer share of the radius is drawn.  mask (x, y, z, label): only places of labels that a node lies on,
    and nodes count only for places of their own label; label 0 is none."""
    spots = nodes.select(*AXES).distinct()
    if mask is not None:
        labels = mask.where("label <> 0").select(*AXES, "label")
        spots = spots.join(labels, list(AXES))
        used = spots.select("label").distinct()
    if edges is not None:
        lines = line_places(nodes, edges)
        spots = spots.unionByName(lines.withColumn("label", F.lit(None).cast(mask.schema["label"].dataType)) if mask is not None else lines)
    o = F.col("offset")
    d2 = sum(((o[f"d{a}"] * s) * (o[f"d{a}"] * s) for a, s in zip(AXES, voxel_size)), F.lit(0.0))
    grown = shifted(spots, ball(radius, voxel_size), keep=("offset",)).withColumn("d2", d2).where(half_open(lo, hi))
    if mask is not None:
        here = labels.join(used, "label", "left_semi").withColumnRenamed("label", "own")
        grown = grown.join(here, list(AXES)).where(F.col("label").isNull() | (F.col("label") == F.col("own")))
    near = grown.groupBy(*AXES).agg(F.min("d2").alias("d2"))
    if ring is not None:
        near = near.where(F.sqrt("d2") > (1 - ring) * radius)
    return near.select(*AXES)


def peaks(nodes: DataFrame, lo, hi, radius: float, edges: DataFrame | None = None, mask: DataFrame | None = None, voxel_size=(1, 1, 1)) -> DataFrame:
    """x, y, z, v: a Gaussian of the radius as deviation around each node's or line's place of the half-open box, summed, brought to 1 at its highest.

    Kernels end at four deviations.  mask as in `draw`, each label's peaks by themselves; with it there are no edges."""
    if mask is not None and edges is not None:
        raise ValueError("peaks inside a mask are those of nodes")
    spots = nodes.select(*AXES).distinct()
    group = []
    if mask is not None:
        spots, group = spots.join(mask.where("label <> 0").select(*AXES, "label"), list(AXES)), ["label"]
    if edges is not None:
        spots = spots.unionByName(line_places(nodes, edges)).distinct()
    out = spots.where(half_open(lo, hi)).withColumn("v", F.lit(1.0))
    for axis, (a, size, low, high) in enumerate(zip(AXES, voxel_size, lo, hi)):
        sigma = radius / size
        half = int(4 * sigma + 0.5)
        kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-0.5 * (k / sigma) ** 2)).alias("w")) for k in range(-half, half + 1)])
        moved = out.withColumn("t", F.explode(kernel)).withColumns({a: (F.col(a) + F.col("t.k")).cast("int"), "v": F.col("v") * F.col("t.w")}).where((F.col(a) >= low) & (F.col(a) < high))
        out = moved.groupBy(*AXES, *group).agg(F.sum("v").alias("v"))
    out = materialised(out, "peaks")
    if mask is None:
        top = out.agg(F.max("v")).first()[0] or 1.0
        return out.select(*AXES, (F.col("v") / F.lit(top)).alias("v"))
    most = out.groupBy("label").agg(F.max("v").alias("top"))
    return out.join(mask.select(*AXES, "label"), [*AXES, "label"]).join(most, "label").select(*AXES, (F.col("v") / F.col("top")).alias("v"))


def plane_radii(nodes: DataFrame, segmentation: DataFrame, most: int = 50, depth: int = 1, pixel: float = 1.0, default: float = 0.1) -> DataFrame:
    """id, radius: distance in the plane from each node (id, x, y, z) to the nearest place on the first square ring around it that the segmentation doesn't fill, in pixels.

    A place is filled if a voxel of the segmentation (x, y, z) lies there within `depth` sections of the node.  Rings grow by
    one a round, for the nodes that are left; those filled to the ring `most` get no row, those without a filled place that
    near get the default."""
    flat = materialised(segmentation.select("x", "y", F.explode(F.sequence(F.col("z") - depth, F.col("z") + depth)).alias("z")).distinct(), "flat")
    side = most + 1
    cells = flat.select("z", "x", "y", cell("x", side).alias("cx"), cell("y", side).alias("cy"))
    asked = nodes.select("id", *AXES)
    around = asked.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    around = around.select("id", "z", F.col("x").alias("px"), F.col("y").alias("py"), (cell("x", side) + F.col("dx")).alias("cx"), (cell("y", side) + F.col("dy")).alias("cy"))
    near = around.join(cells, ["cx", "cy", "z"]).where((F.abs(F.col("x") - F.col("px")) <= most) & (F.abs(F.col("y") - F.col("py")) <= most)).select("id").distinct()
    left = materialised(asked.join(near, "id", "left_semi"), "open")
    out = asked.join(near, "id", "left_anti").select("id", F.lit(default).alias("radius"))
    for r in range(1, most + 1):
        if left.isEmpty():
            break
        ring = [(i, j) for i in range(-r, r + 1) for j in range(-r, r + 1) if max(abs(i), abs(j)) == r]
        offs = F.expr("array(" + ",".join(f"named_struct('i',{i},'j',{j})" for i, j in ring) + ")")
        seen = left.withColumn("o", F.explode(offs)).select("id", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"), "z", (F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")).alias("d2"))
        found = materialised(seen.join(flat, list(AXES), "left_anti").groupBy("id").agg((F.sqrt(F.min("d2")) * pixel).alias("radius")), "found")
        out = out.unionByName(found)
        left = materialised(left.join(found, "id", "left_anti"), "open")
    return out


def tree_radii(nodes: DataFrame, tree: str, segmentation: DataFrame, step: int = 10, **options) -> DataFrame:
    """id, radius of every node: read from the segmentation at nodes whose id is a multiple of `step` and at roots, and filled along the tree from the nearest of these."""
    some = nodes.where((F.col("id") % step == 0) | (F.col("parent") == -1))
    read = plane_radii(some, segmentation, **options)
    told = nodes.drop("radius").join(read, "id", "left")
    return filled_from_tree(told, tree, "radius", options.get("default", 0.1)).select("id", F.col("value").alias("radius"))
