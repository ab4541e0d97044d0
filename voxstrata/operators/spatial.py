"""Spatial joins.  All are equi-joins on grid cells with an exact condition after, never a cross product."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxstrata.functions.boxes import AXES, cell, closed, offset_array, offsets, overlap_closed, shifted, squared_distance
from voxstrata.functions.shared import materialised


def bounding_boxes(nodes: DataFrame, key: str) -> DataFrame:
    """key, min_x .. max_z, n of each group of nodes."""
    return nodes.groupBy(key).agg(*[F.min(a).alias(f"min_{a}") for a in AXES], *[F.max(a).alias(f"max_{a}") for a in AXES], F.count("*").alias("n"))


def _cells_of_box(df: DataFrame, size: int, prefix: str) -> DataFrame:
    for a in AXES:
        df = df.withColumn(f"c{a}", F.explode(F.sequence(cell(f"{prefix}min_{a}", size), cell(f"{prefix}max_{a}", size))))
    return df


def boxes_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: int) -> DataFrame:
    """(left_id, right_id) of closed boxes that overlap or touch.

    Each pair meets in the one cell that holds the low corner of the intersection, so nothing has to be made distinct."""
    pre = lambda df, p, i: df.select(F.col(i).alias(f"{p}id"), *[F.col(f"{e}_{a}").alias(f"{p}{e}_{a}") for e in ("min", "max") for a in AXES])
    one, two = _cells_of_box(pre(left, "l_", left_id), size, "l_"), _cells_of_box(pre(right, "r_", right_id), size, "r_")
    home = F.lit(True)
    for a in AXES:
        home = home & (F.col(f"c{a}") == cell(F.greatest(f"l_min_{a}", f"r_min_{a}"), size))
    return one.join(two, ["cx", "cy", "cz"]).where(overlap_closed("l_", "r_") & home).select(F.col("l_id").alias(left_id), F.col("r_id").alias(right_id))


def points_in_boxes(points: DataFrame, boxes: DataFrame, point_id: str, box_id: str, size: int) -> DataFrame:
    """(point_id, box_id) of points in closed boxes; a point is in one cell, so pairs are distinct."""
    b = _cells_of_box(boxes.select(F.col(box_id).alias("box"), *[f"{e}_{a}" for e in ("min", "max") for a in AXES]), size, "")
    p = points.select(F.col(point_id).alias("point"), *AXES, *[cell(a, size).alias(f"c{a}") for a in AXES])
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"min_{a}"), F.col(f"max_{a}"))
    return p.join(b, ["cx", "cy", "cz"]).where(inside).select(F.col("point").alias(point_id), F.col("box").alias(box_id))


#: Rows in one packed row of a cell: what a task holds of a cell at once.
PACK = 512


def packed_cells(rows: DataFrame, size, cols, order, name: str) -> DataFrame:
    """cx, cy, cz and name, an array of structs of cols: the rows of each grid cell, at most PACK in an array."""
    at = rows.select(F.struct(*cols).alias("row"), *[cell(a, size).alias(f"c{a}") for a in AXES])
    in_cell = Window.partitionBy("cx", "cy", "cz").orderBy(*[f"row.{c}" for c in order] or ["cx"])
    numbered = at.withColumn("pack", F.floor((F.row_number().over(in_cell) - 1) / PACK))
    return numbered.groupBy("cx", "cy", "cz", "pack").agg(F.collect_list("row").alias(name)).drop("pack")


def met_in_cells(one: DataFrame, two: DataFrame, around) -> DataFrame:
    """Rows of packed cells (array a) with those of packed cells (array b) at each of the offsets around: every field as a_<field> and b_<field>, and apart, false within one cell.

    Cells meet as arrays, and rows within a task, so that what goes to the shuffle is a cell's rows once for each offset.
    Neither side may be broadcast: Spark takes a table for as small as it was before its rows were multiplied."""
    moved = one.withColumn("o", F.explode(offset_array(around))).select("a", *[(F.col(f"c{x}") + F.col(f"o.d{x}")).alias(f"c{x}") for x in AXES], ((F.col("o.dx") != 0) | (F.col("o.dy") != 0) | (F.col("o.dz") != 0)).alias("apart"))
    met = moved.hint("merge").join(two.hint("merge"), ["cx", "cy", "cz"])
    fields = lambda df, k: [f.name for f in df.schema[k].dataType.elementType.fields]
    left = met.select(F.explode("a").alias("p"), "b", "apart").select(*[F.col(f"p.{c}").alias(f"a_{c}") for c in fields(one, "a")], "b", "apart")
    kept = [c for c in left.columns if c != "b"]
    return left.select(*kept, F.explode("b").alias("q")).select(*kept, *[F.col(f"q.{c}").alias(f"b_{c}") for c in fields(two, "b")])


def distance_pairs(points: DataFrame, radius: int, group: str | None = None, carry=()) -> DataFrame:
    """id1 < id2, d2 of points within radius (inclusive), of different groups if group is named.  Cells are as large as the radius.

    Of two cells side by side only one looks into the other.  Columns named in carry come along, as <name>1 and <name>2."""
    cols = list(dict.fromkeys(["id", *AXES, *([group] if group else []), *carry]))
    cells = lambda k: packed_cells(points.select(cols), radius, cols, ["id"], k)
    met = met_in_cells(cells("a"), cells("b"), [(0, 0, 0), *[o for o in offsets(1) if o > (0, 0, 0)]])
    d2 = squared_distance("a_", "b_")
    on = (d2 <= radius * radius) & ((F.col("a_id") < F.col("b_id")) | (F.col("apart") & (F.col("a_id") > F.col("b_id"))))
    if group:
        on = on & (F.col(f"a_{group}") != F.col(f"b_{group}"))
    first = F.col("a_id") < F.col("b_id")
    side = lambda c, k: F.when(first if k == 1 else ~first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"{c}{k}")
    return met.where(on).select(side("id", 1), side("id", 2), d2.alias("d2"), *[side(c, k) for c in carry for k in (1, 2)])


#: Points in one of the first cells of a search for k neighbours, times k + 1, at most.
CROWD = 64


def knn(queries: DataFrame, points: DataFrame, k: int, same: bool = False) -> DataFrame:
    """id, nn, rank, d2: each query's k nearest points, ties to the smaller id; same leaves a point of the query's own id out.

    The first cells are as large as holds k points in the mean.  Queries look into the 27 cells around them, which surely
    hold all points within a cell's size; those whose kth point is farther go on with cells twice as large, until one
    cell spans all points.  Where there are no more than k points, all are near."""
    ends = lambda df: df.agg(F.count("*").alias("n"), *[f(F.col(a)).alias(f"{e}{a}") for a in AXES for e, f in (("lo", F.min), ("hi", F.max))]).first()
    here, there = ends(points), ends(queries)
    if not here.n or not there.n:
        return queries.select("id", F.col("id").alias("nn"), F.lit(1).alias("rank"), F.lit(0).alias("d2")).limit(0)
    span = 1 + max(max(here["hi" + a], there["hi" + a]) - min(here["lo" + a], there["lo" + a]) for a in AXES)
    volume = float(np.prod([1.0 + here["hi" + a] - here["lo" + a] for a in AXES]))
    size = span if here.n <= k + same else max(1, min(span, round((volume * k / here.n) ** (1 / 3))))
    heavy = points.groupBy(*AXES).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if heavy > k + 1:  # the limit is applied before the shuffle too
        points = materialised(points.withColumn("r", F.row_number().over(Window.partitionBy(*AXES).orderBy("id"))).where(F.col("r") <= k + 1).drop("r"), "places")
    while size > 1 and points.groupBy(*[cell(a, size).alias(f"c{a}") for a in AXES]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] > CROWD * (k + 1):
        size = max(1, size // 2)
    left, done = queries.select("id", *[F.col(a).alias(f"q_{a}") for a in AXES]), None
    best = Window.partitionBy("id").orderBy("d2", "nn")
    while True:
        q = packed_cells(left.select("id", *[F.col(f"q_{a}").alias(a) for a in AXES]), size, ["id", *AXES], ["id"], "a")
        p = packed_cells(points.select("id", *AXES), size, ["id", *AXES], ["id"], "b")
        found = met_in_cells(q, p, [(0, 0, 0), *offsets(1)]).select(F.col("a_id").alias("id"), F.col("b_id").alias("nn"), squared_distance("a_", "b_").alias("d2"))
        if size < span:  # what is farther is looked at again, with larger cells
            found = found.where(F.col("d2") <= size * size)
        if same:
            found = found.where("id <> nn")
        if k == 1:  # an aggregate that starts before anything is shuffled
            top = found.groupBy("id").agg(F.min(F.struct("d2", "nn")).alias("m")).select("id", "m.nn", F.lit(1).alias("rank"), "m.d2")
        else:
            top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "nn", "rank", "d2")
        if size >= span:
            return top if done is None else done.unionByName(top)
        top = materialised(top, "knn")
        sure = top.where((F.col("rank") == k) & (F.col("d2") <= size * size)).select("id").hint("merge")
        got = top.join(sure, "id", "left_semi")
        done = got if done is None else done.unionByName(got)
        left = materialised(left.join(sure, "id", "left_anti"), "unfinished")
        if left.isEmpty():
            return done
        size *= 2


def relabel_nearest(labelled: DataFrame, points: DataFrame) -> DataFrame:
    """Voxels of components that a point lies in get the id of the nearest point of all; other components are dropped (zero)."""
    hit = labelled.join(points.select(*AXES).distinct(), list(AXES), "left_semi").select("label").distinct()
    mine = labelled.join(hit, "label", "left_semi")
    q = mine.select((F.struct(*AXES)).alias("id"), *AXES)
    near = knn(q, points, 1)
    return near.select(*[F.col(f"id.{a}").alias(a) for a in AXES], F.col("nn").alias("id"))


def affinities(classed: DataFrame, offs, column: str = "c") -> DataFrame:
    """x, y, z, offset (its ordinal) where a voxel and the one at the offset have the same class above zero."""
    kept = classed.where(F.col(column) > 0)
    sides = [F.struct(*[F.lit(o[i]).alias(f"d{a}") for i, a in enumerate(AXES)], F.lit(k).alias("offset")) for k, o in enumerate(offs)]
    moved = kept.withColumn("o", F.explode(F.array(*sides))).select(*[F.col(a).alias(f"from_{a}") for a in AXES], *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], F.col(column), F.col("o.offset").alias("offset"))
    return moved.join(kept.select(*AXES, column), [*AXES, column]).select(*[F.col(f"from_{a}").alias(a) for a in AXES], "offset")


def affinities_between(one: DataFrame, two: DataFrame, offs) -> DataFrame:
    """x, y, z, offset (its ordinal), a: the bits that a value of one shares with the value of two at the place less the offset, where there are any."""
    sides = [F.struct(*[F.lit(o[i]).alias(f"d{a}") for i, a in enumerate(AXES)], F.lit(k).alias("offset")) for k, o in enumerate(offs)]
    moved = two.where("v <> 0").withColumn("o", F.explode(F.array(*sides))).select(*[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], F.col("v").alias("w"), F.col("o.offset").alias("offset"))
    both = F.col("v").bitwiseAND(F.col("w"))
    return moved.join(one.select(*AXES, "v"), list(AXES)).where(both != 0).select(*AXES, "offset", both.alias("a"))


def filter_skeletons(nodes: DataFrame, lo, hi, key: str) -> DataFrame:
    """Nodes of the groups with any node, cut to whole numbers, in the closed box."""
    whole = nodes.select(key, *[F.col(a).cast("int").alias(a) for a in AXES])
    return nodes.join(whole.where(closed(lo, hi)).select(key).distinct(), key, "left_semi")


__all__ = ["affinities", "affinities_between", "bounding_boxes", "boxes_overlap", "distance_pairs", "filter_skeletons", "knn", "points_in_boxes", "relabel_nearest", "shifted"]
