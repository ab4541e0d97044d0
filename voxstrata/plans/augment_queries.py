"""Queries over training-time changes, and tiles and affinities between two volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES
from voxstrata.operators import augment, blend, spatial, tiling, voxel
from voxstrata.plans.registry import query
from voxstrata.plans.voxel_queries import _AXIS, HI, LO, G, V
from voxstrata.sources.tables import voxels

#: A coordinate mirrored at 0 and 31 by no more than 32.
_MIRROR = lambda c: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} > 31 THEN 63 - ({c}) ELSE {c} END"


@query(G + " SELECT x, y, z, round(v + 0.03::DOUBLE, 6) AS v FROM g")
def k_brightness(spark, sf):
    return augment.brightness(voxels(spark, sf), 0.03, LO, HI).select(*AXES, F.round("v", 6).alias("v"))


def _pass(source: str, axis: str, sigma: float) -> str:
    """SQL of a Gaussian along one axis."""
    half = int(4 * sigma + 0.5)
    cols = ", ".join(f"CAST(p.i AS int) AS {a}" if a == axis else f"b.{a}" for a in AXES)
    return f"(SELECT {cols}, sum(b.v * w) AS v FROM (SELECT s.i, {_MIRROR('s.i + o')} AS f, w FROM s, (SELECT range - {half} AS o, exp(-0.5 * pow((range - {half}) / {sigma}::DOUBLE, 2)) / (SELECT sum(exp(-0.5 * pow((range - {half}) / {sigma}::DOUBLE, 2))) FROM range({2 * half + 1})) AS w FROM range({2 * half + 1}))) p JOIN {source} b ON b.{axis} = p.f GROUP BY ALL)"


@query(G + f", a AS {_pass('g', 'x', 1.5)}, b AS {_pass('a', 'y', 1.5)}, c AS {_pass('b', 'z', 0.66)}, d AS (SELECT range - 1 AS o FROM range(3)), m AS (SELECT t.x, t.y, t.z, any_value(t.v) AS raw, median(q.v) AS med FROM g t, d i, d j, d k JOIN g q ON q.x = {_MIRROR('t.x + i.o')} AND q.y = {_MIRROR('t.y + j.o')} AND q.z = {_MIRROR('t.z + k.o')} GROUP BY t.x, t.y, t.z) SELECT x, y, z, round(c.v + raw - med, 4) + 0.0 AS v FROM c JOIN m USING (x, y, z)")
def k_blur(spark, sf):
    return augment.blur(voxels(spark, sf), {"x": 1.5, "y": 1.5, "z": 0.66}, LO, HI).select(*AXES, (F.round("v", 4) + 0.0).alias("v"))


@query(G + f", l AS (SELECT * FROM g WHERE z BETWEEN 10 AND 13), d AS (SELECT range - 1 AS o FROM range(3)), m AS (SELECT t.x, t.y, t.z, any_value(t.v) AS raw, avg(q.v) AS mean FROM l t, d i, d j, d k JOIN l q ON q.x = {_MIRROR('t.x + i.o')} AND q.y = {_MIRROR('t.y + j.o')} AND q.z = least(greatest(t.z + k.o, 10), 13) GROUP BY t.x, t.y, t.z) SELECT m.x, m.y, m.z, round(f.v + raw - mean, 4) + 0.0 AS v FROM m JOIN g f ON f.x = m.x AND f.y = m.y AND f.z = 10 UNION ALL SELECT x, y, z, v::DOUBLE FROM g WHERE z NOT BETWEEN 10 AND 13")
def k_duplicate(spark, sf):
    return augment.duplicate_sections(voxels(spark, sf), "z", 10, 4, LO, HI).select(*AXES, (F.round("v", 4) + 0.0).alias("v"))


@query(G + ", p AS (SELECT *, CASE WHEN x BETWEEN 6 AND 25 AND y BETWEEN 4 AND 23 AND z BETWEEN 8 AND 15 THEN exp(-((x - 16) * (x - 16) / 50.0::DOUBLE + (y - 14) * (y - 14) / 50.0::DOUBLE + (z - 12) * (z - 12) / 8.0::DOUBLE)) ELSE 0 END AS s FROM g) SELECT x, y, z, CAST(trunc(v * (1 - s) + s * 100.3::DOUBLE) AS int) AS v FROM p")
def k_occlude(spark, sf):
    return augment.occlude(voxels(spark, sf), (16, 14, 12), (10, 10, 4), (5, 5, 2), 100.3, LO, HI)


@query(V + " SELECT x, CAST(CASE WHEN x < 12 THEN y - 5 ELSE y END AS int) AS y, z, v FROM v WHERE CASE WHEN x < 12 THEN y - 5 ELSE y END BETWEEN 0 AND 26")
def k_stitch(spark, sf):
    return augment.stitch(voxels(spark, sf), "x", 12, 5, "y", 0, 32)


@query(V + " SELECT 0 AS n, x, y, z, v FROM v UNION ALL SELECT 1, x, y, z, 255 - v FROM v")
def c_stack(spark, sf):
    v = voxels(spark, sf)
    return augment.stack([v, v.withColumn("v", 255 - F.col("v"))])


@query("SELECT CAST(k AS bigint) AS chunk, CAST(5 + a AS int) AS x0, CAST(37 + a AS int) AS x1, CAST(6 + b AS int) AS y0, CAST(38 + b AS int) AS y1, CAST(7 + c AS int) AS z0, CAST(39 + c AS int) AS z1 FROM (VALUES (0, 0, 0, 0), (1, 16, 0, 0), (2, 0, 16, 0), (3, 0, 0, 16)) t(k, a, b, c)")
def e_overlap_chunks(spark, sf):
    return tiling.overlap_chunks(spark, (5, 6, 7), (37, 38, 39), 16)


@query(V + ", b AS (SELECT x, y, z, (v * 7 + 3) % 256 AS v FROM v), o AS (SELECT * FROM (VALUES (1,0,0,0),(0,-2,0,1),(0,0,3,2)) t(a, b, d, k)) SELECT v.x, v.y, v.z, CAST(k AS int) AS \"offset\", CAST(v.v & b.v AS int) AS a FROM v, o JOIN b ON b.x = v.x - a AND b.y = v.y - b AND b.z = v.z - d WHERE v.v & b.v <> 0")
def f_affinities_between(spark, sf):
    v = voxels(spark, sf)
    other = v.withColumn("v", ((F.col("v") * 7 + 3) % 256).cast("int"))
    return spatial.affinities_between(v, other, [(1, 0, 0), (0, -2, 0), (0, 0, 3)])


@query(_AXIS.format("-1 / (1 - pow((c + 1) / 9.0::DOUBLE * 2 - 1, 2))") + " SELECT dx, dy, dz, CASE WHEN dx < 2 OR dy >= 7 THEN 0 ELSE round(sum(CASE WHEN own THEN exp(l) ELSE 0 END) / sum(exp(l)), 6) END AS w FROM u GROUP BY dx, dy, dz")
def g_mask_edge(spark, sf):
    return blend.mask_edge(blend.weights(spark, 8, 4, "wu"), 8, (2, -1, 0)).select("dx", "dy", "dz", F.round("w", 6).alias("w"))


@query(V + " SELECT x, y, z, CAST(greatest(v - 100, 0) AS int) AS v FROM v")
def c_no_negative(spark, sf):
    return voxels(spark, sf).select(*AXES, voxel.no_negative(F.col("v") - 100).alias("v"))
