"""Queries over voxels: columns, filters, tiles, blends, labels and morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES, cell, closed, half_open
from voxstrata.operators import blend, cc, model, morphology, skeletons, tiling, voxel
from voxstrata.plans.registry import query
from voxstrata.sources.tables import SIDE, VOXELS, voxels

V = f"WITH RECURSIVE v AS ({VOXELS})"
#: The grid's places, dense.
G = V + ", s AS (SELECT CAST(range AS int) AS i FROM range(32)), g AS (SELECT a.i AS x, b.i AS y, c.i AS z, coalesce(v.v, 0) AS v FROM s a, s b, s c LEFT JOIN v ON v.x = a.i AND v.y = b.i AND v.z = c.i)"
LO, HI = (0, 0, 0), (SIDE, SIDE, SIDE)


def _cc(source: str) -> str:
    """Component labels of (x, y, z, c) rows by a keyed recursion."""
    return f"""{V}, f AS (SELECT x, y, z, (x * 32 + y) * 32 + z AS k, c FROM ({source})),
e AS (SELECT a.k AS a, b.k AS b FROM f a JOIN f b ON a.c = b.c AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 AND a.x BETWEEN b.x - 1 AND b.x + 1),
r(k, label) USING KEY (k) AS (SELECT k, k FROM f UNION SELECT e.b, min(r.label) FROM r JOIN e ON e.a = r.k JOIN recurring.r AS o ON o.k = e.b WHERE r.label < o.label GROUP BY e.b),
l AS (SELECT x, y, z, CAST(label AS bigint) AS label FROM r JOIN f USING (k))"""


@query(_cc("SELECT x, y, z, 1 AS c FROM v WHERE v >= 225") + " SELECT n AS size, count(*) AS n_components FROM (SELECT label, count(*) AS n FROM l GROUP BY label) WHERE n >= 10 GROUP BY n")
def h_cc_histogram(spark, sf):
    sizes = cc.label_voxels(voxel.threshold(voxels(spark, sf), 225), SIDE, block=8).groupBy("label").agg(F.count("*").alias("size"))
    return sizes.where("size >= 10").groupBy("size").agg(F.count("*").alias("n_components"))


@query(_cc("SELECT x, y, z, 1 AS c FROM v WHERE v >= 225") + ", n AS (SELECT label, count(*) AS n FROM l GROUP BY label) SELECT x, y, z, label FROM l JOIN n USING (label) WHERE n >= 10 OR (SELECT count(*) FROM n) <= 1")
def h_cc_remove_small(spark, sf):
    return cc.remove_small(cc.label_voxels(voxel.threshold(voxels(spark, sf), 225), SIDE, block=8), 10).select(*AXES, "label")


@query(_cc("SELECT x, y, z, v // 64 AS c FROM v WHERE v >= 64") + " SELECT x, y, z, label FROM l")
def h_renumber_equal_value(spark, sf):
    classed = voxels(spark, sf).where("v >= 64").withColumn("c", F.floor(F.col("v") / 64))
    return cc.label_voxels(classed, SIDE, block=8, cls="c")


@query(V + """, c AS (SELECT x, y, z, v // 128 AS l FROM v), o AS (SELECT * FROM (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) t(a, b, d))
SELECT c.x, c.y, c.z, CAST(c.l AS bigint) AS label FROM c, o LEFT JOIN c n ON n.x = c.x + a AND n.y = c.y + b AND n.z = c.z + d AND n.l = c.l
GROUP BY c.x, c.y, c.z, c.l HAVING count(*) FILTER (WHERE n.x IS NOT NULL OR c.x + a NOT BETWEEN 0 AND 31 OR c.y + b NOT BETWEEN 0 AND 31 OR c.z + d NOT BETWEEN 0 AND 31) = 6""")
def h_erode_labels(spark, sf):
    return morphology.erode(voxels(spark, sf).select(*AXES, F.floor(F.col("v") / 128).alias("label")), SIDE)


@query(G + " SELECT g.x, g.y, g.z FROM g WHERE EXISTS (SELECT 1 FROM v f WHERE f.v >= 250 AND (f.x-g.x)*(f.x-g.x)+(f.y-g.y)*(f.y-g.y)+(f.z-g.z)*(f.z-g.z) <= 4)")
def h_dilate_radius(spark, sf):
    return morphology.dilate(voxel.threshold(voxels(spark, sf), 250), 2, SIDE)


@query(G + " SELECT g.x, g.y, g.z, CAST(min((f.x-g.x)*(f.x-g.x)+(f.y-g.y)*(f.y-g.y)+(f.z-g.z)*(f.z-g.z)) AS int) AS d2 FROM g JOIN v f ON f.v >= 250 AND (f.x-g.x)*(f.x-g.x)+(f.y-g.y)*(f.y-g.y)+(f.z-g.z)*(f.z-g.z) <= 9 GROUP BY g.x, g.y, g.z")
def h_distance_within(spark, sf):
    return morphology.distances(voxel.threshold(voxels(spark, sf), 250), 3, SIDE).select(*AXES, F.col("d2").cast("int").alias("d2"))


@query(V + " SELECT b.x, b.y, b.z, (c.v - a.v) / 2.0 AS gx FROM v b JOIN v a ON a.x = b.x - 1 AND a.y = b.y AND a.z = b.z JOIN v c ON c.x = b.x + 1 AND c.y = b.y AND c.z = b.z WHERE EXISTS (SELECT 1 FROM v q WHERE q.x = b.x AND q.y = b.y - 1 AND q.z = b.z) AND EXISTS (SELECT 1 FROM v q WHERE q.x = b.x AND q.y = b.y + 1 AND q.z = b.z) AND EXISTS (SELECT 1 FROM v q WHERE q.x = b.x AND q.y = b.y AND q.z = b.z - 1) AND EXISTS (SELECT 1 FROM v q WHERE q.x = b.x AND q.y = b.y AND q.z = b.z + 1)")
def h_gradient(spark, sf):
    return morphology.gradient(voxels(spark, sf)).select(*AXES, "gx")


@query(V + " SELECT x, y, z, v FROM v WHERE v >= 200")
def c_threshold(spark, sf):
    return voxel.threshold(voxels(spark, sf), 200)


@query(V + " SELECT x, y, z, round(v * 1.5 + 3, 6) AS v FROM v")
def c_scale_shift(spark, sf):
    return voxels(spark, sf).select(*AXES, F.round(voxel.scale_shift(F.col("v"), 1.5, 3), 6).alias("v"))


@query(V + " SELECT x, y, z, round(v * (1 / 255.0::DOUBLE), 6) AS v FROM v")
def c_normalize(spark, sf):
    return voxels(spark, sf).select(*AXES, F.round(voxel.normalise(F.col("v"), "uint8"), 6).alias("v"))


@query(V + " SELECT x, y, z, CAST(trunc((v - 100) * 0.7::DOUBLE) AS int) AS v FROM v")
def c_cast_truncate(spark, sf):
    return voxels(spark, sf).select(*AXES, voxel.cast_truncate((F.col("v") - 100) * 0.7).alias("v"))


@query(V + " SELECT x, y, z, CAST(CASE WHEN v >= 180 THEN 255 ELSE round_even(v * (255.0::DOUBLE / 180), 0) END AS int) AS v FROM v")
def c_lut_range(spark, sf):
    return voxels(spark, sf).select(*AXES, voxel.lut(F.col("v"), 180).alias("v"))


@query(G + """, p AS (SELECT x // 8 AS bx, y // 8 AS by_, z // 8 AS bz, quantile_cont(v::DOUBLE, [0.05, 0.95]) AS q FROM g GROUP BY ALL)
SELECT x, y, z, CAST(trunc(least(greatest((v - q[1]) * CASE WHEN q[2] > q[1] THEN 1 / (q[2] - q[1]) ELSE 1 END, 0), 1) * 255) AS int) AS v
FROM v JOIN p ON bx = x // 8 AND by_ = y // 8 AND bz = z // 8""")
def c_percentile_stretch(spark, sf):
    return voxel.percentile_stretch(voxels(spark, sf), 8, 0.05, 0.95)


@query(V + ", m AS (SELECT range * 2 AS old, CAST(range + 1000 AS int) AS new FROM range(100)) SELECT x, y, z, coalesce(new, v) AS v FROM v LEFT JOIN m ON old = v")
def c_remap_labels(spark, sf):
    mapping = spark.range(100).select((F.col("id") * 2).cast("int").alias("old"), (F.col("id") + 1000).cast("int").alias("new"))
    return voxel.remap(voxels(spark, sf), mapping)


@query(V + " SELECT x, y, z, CASE WHEN v IN (1, 5, 9, 200) THEN 0 ELSE v END AS v FROM v")
def c_exclude_labels(spark, sf):
    return voxel.exclude_labels(voxels(spark, sf), [1, 5, 9, 200])


@query(G + ", c AS (SELECT x, y, z, 7 AS v FROM g WHERE z % 6 = 0 UNION ALL SELECT x, y, z, CASE WHEN z % 3 = 0 THEN 7 ELSE v END FROM v WHERE z % 6 <> 0), d AS (SELECT g.z, coalesce(c.v, 0) AS v FROM g LEFT JOIN c ON c.x = g.x AND c.y = g.y AND c.z = g.z), k AS (SELECT z, min(v) = max(v) AS flat FROM d GROUP BY z) SELECT x, y, z, CASE WHEN flat THEN 0 ELSE v END AS v FROM c JOIN k USING (z)")
def c_zero_const_sections(spark, sf):
    """Sections of sevens: full ones are constant, those with empty places aren't."""
    v = voxels(spark, sf)
    full = voxel.densify(v, LO, HI).where("z % 6 = 0").withColumn("v", F.lit(7))
    return voxel.zero_constant_sections(full.unionByName(v.where("z % 6 <> 0").withColumn("v", F.when(F.col("z") % 3 == 0, 7).otherwise(F.col("v")))), SIDE * SIDE)


@query(V + " SELECT x, y, max(v) AS v FROM v GROUP BY x, y")
def g_max_projection(spark, sf):
    return voxel.max_projection(voxels(spark, sf))


@query(V + " SELECT x, y, z, round(1 / (1 + exp(-(v - 128) / 32.0::DOUBLE)), 6) AS v FROM v")
def c_sigmoid(spark, sf):
    return voxels(spark, sf).select(*AXES, F.round(voxel.sigmoid((F.col("v") - 128) / 32.0), 6).alias("v"))


@query(V + " SELECT * FROM v WHERE x >= 4 AND x < 20 AND y >= 8 AND z < 16")
def d_roi_half_open(spark, sf):
    return voxels(spark, sf).where(half_open((4, 8, None), (20, None, 16)))


@query(V + " SELECT * FROM v WHERE x BETWEEN 4 AND 20 AND y BETWEEN 8 AND 16 AND z BETWEEN 0 AND 16")
def d_box_closed(spark, sf):
    return voxels(spark, sf).where(closed((4, 8, 0), (20, 16, 16)))


@query(V + " SELECT * FROM v WHERE x >= 8 AND x < 24 AND y >= 3 AND y < 32 AND z < 29")
def d_crop_fraction(spark, sf):
    return voxels(spark, sf).where(half_open(*voxel.crop_fraction(LO, HI, (0.25, 0.1, 0.0), (0.25, 0.0, 0.1))))


@query(G + ", b AS (SELECT CAST(range - 2 AS int) AS i FROM range(36)) SELECT p.i AS x, q.i AS y, r.i AS z, coalesce(g.v, 9) AS v FROM b p, b q, b r LEFT JOIN g ON g.x = p.i AND g.y = q.i AND g.z = r.i")
def d_pad_constant(spark, sf):
    return voxel.pad_constant(voxels(spark, sf), LO, HI, 2, 9)


@query(G + ", b AS (SELECT CAST(range - 2 AS int) AS i, CASE WHEN range < 2 THEN 2 - range WHEN range > 33 THEN 64 - range ELSE range - 2 END AS f FROM range(36)) SELECT p.i AS x, q.i AS y, r.i AS z, g.v FROM b p, b q, b r, g WHERE g.x = p.f AND g.y = q.f AND g.z = r.f")
def d_pad_reflect(spark, sf):
    return voxel.pad_reflect(voxels(spark, sf), LO, HI, 2)


@query(G + ", m AS (SELECT x // 4 AS mx, y // 4 AS my, z // 4 AS mz, max(v) >= 250 AS m FROM g GROUP BY ALL), k AS (SELECT mx // 2 AS bx, my // 2 AS by_, mz // 2 AS bz, bool_and(m) AS every FROM m GROUP BY ALL) SELECT DISTINCT CAST(x // 8 AS int) AS bx, CAST(y // 8 AS int) AS by, CAST(z // 8 AS int) AS bz FROM g JOIN k ON bx = x // 8 AND by_ = y // 8 AND bz = z // 8 WHERE v <> 0 AND NOT every")
def d_mask_block_skip(spark, sf):
    v = voxels(spark, sf)
    mask = v.groupBy(*[cell(a, 4).alias(a) for a in AXES]).agg((F.max("v") >= 250).cast("int").alias("m"))
    return voxel.kept_blocks(v, mask, 8, 4)


_TILES = "WITH a AS (SELECT range AS i FROM range(4)) SELECT CAST((p.i * 4 + q.i) * 4 + r.i AS bigint) AS tile, {} FROM a p, a q, a r"
_tile = lambda start, end: ", ".join(f"CAST({start.format(t)} AS int) AS {a}0, CAST({end.format(t)} AS int) AS {a}1" for a, t in zip(AXES, ("p.i", "q.i", "r.i")))


@query(_TILES.format(_tile("{0} * 30", "least({0} * 30 + 30, 100)")))
def e_tile_grid(spark, sf):
    return tiling.tile_grid(spark, (100, 100, 100), 30)


@query(_TILES.format(_tile("greatest({0} * 30 - 4, 0)", "least(least({0} * 30 + 30, 100) + 4, 100)")))
def e_tile_overlap(spark, sf):
    return tiling.tile_grid(spark, (100, 100, 100), 30, 4)


@query(_TILES.format(_tile("CASE WHEN {0} = 3 THEN 70 ELSE {0} * 30 END", "least({0} * 30 + 30, 100)")))
def e_tile_snap_back(spark, sf):
    return tiling.snap_back(tiling.tile_grid(spark, (100, 100, 100), 30), (100, 100, 100), 30)


@query(_TILES.format(_tile("{0} * 30 + 10", "least(least({0} * 30 + 30, 100) + 10, 75)")) + " WHERE p.i * 30 + 10 <= 60 AND q.i * 30 + 10 <= 60 AND r.i * 30 + 10 <= 60")
def e_cutout_tiles(spark, sf):
    return tiling.cutout_tiles(spark, (100, 100, 100), 30, (10, 10, 10), (60, 60, 60))


@query(G + ", a AS (SELECT x, y, z, sum(v) OVER (PARTITION BY y, z ORDER BY x) AS s FROM g), b AS (SELECT x, y, z, sum(s) OVER (PARTITION BY x, z ORDER BY y) AS s FROM a) SELECT x, y, z, CAST(sum(s) OVER (PARTITION BY x, y ORDER BY z) AS bigint) AS s FROM b")
def e_integral_image(spark, sf):
    return tiling.integral_image(voxel.densify(voxels(spark, sf), LO, HI))


@query(V + ", w AS (SELECT CAST(range AS int) AS i FROM range(4)) SELECT p.i AS wx, q.i AS wy, r.i AS wz, count(*) AS n FROM w p, w q, w r JOIN v ON v >= 252 AND x >= p.i * 8 AND x < p.i * 8 + 8 AND y >= q.i * 8 AND y < q.i * 8 + 8 AND z >= r.i * 8 AND z < r.i * 8 + 8 GROUP BY ALL")
def e_windows_with_data(spark, sf):
    return tiling.windows_with_data(voxel.threshold(voxels(spark, sf), 252), 8, 8, SIDE)


@query(V + ", w AS (SELECT CAST(range - 0 AS int) AS i FROM range(4)) SELECT CAST(p.i AS int) AS bx, CAST(q.i AS int) AS by, CAST(r.i AS int) AS bz, count(*) AS n FROM w p, w q, w r JOIN v ON x >= p.i * 8 - 2 AND x < p.i * 8 + 10 AND y >= q.i * 8 - 2 AND y < q.i * 8 + 10 AND z >= r.i * 8 - 2 AND z < r.i * 8 + 10 GROUP BY ALL")
def e_halo(spark, sf):
    return tiling.halo(voxels(spark, sf), 8, 2).where("bx < 4 and by < 4 and bz < 4").groupBy("bx", "by", "bz").agg(F.count("*").alias("n"))


_TWO = V + ", t AS (SELECT x, y, z, v, 0 AS tile FROM v UNION ALL SELECT x + 10, y, z, 255 - v, 1 FROM v)"


def _two(spark, sf):
    v = voxels(spark, sf)
    return blend.place(v, (0, 0, 0), 0).unionByName(blend.place(v.withColumn("v", 255 - F.col("v")), (10, 0, 0), 1))


@query(_TWO + " SELECT x, y, z, max(v) AS v FROM t GROUP BY x, y, z")
def g_blend_max(spark, sf):
    return blend.blend_max(_two(spark, sf))


@query(_TWO + " SELECT x, y, z, arg_max(v, tile) AS v FROM t GROUP BY x, y, z")
def g_blend_last_wins(spark, sf):
    return blend.blend_last(_two(spark, sf))


@query(_TWO + " SELECT x, y, z, round(sum(v * (tile + 1.0::DOUBLE)) / sum(tile + 1.0::DOUBLE), 6) AS v FROM t GROUP BY x, y, z")
def g_blend_weighted(spark, sf):
    return blend.blend_weighted(_two(spark, sf), F.col("tile") + 1.0).select(*AXES, F.round("v", 6).alias("v"))


_AXIS = "WITH a AS (SELECT CAST(d.range AS int) AS d, o.range AS o, d.range - o.range * 4 AS c FROM range(8) d, range(-1, 2) o WHERE d.range - o.range * 4 BETWEEN 0 AND 7), k AS (SELECT d, o, {} AS l FROM a), u AS (SELECT x.d AS dx, y.d AS dy, z.d AS dz, x.o = 0 AND y.o = 0 AND z.o = 0 AS own, x.l + y.l + z.l AS l FROM k x, k y, k z)"


_ZUNG = _AXIS.format("-pow((c + 1) / 9.0::DOUBLE * (1 - (c + 1) / 9.0::DOUBLE), -1.5)") + ", m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY dx, dy, dz)) AS b FROM u)"


@query(_ZUNG + " SELECT dx, dy, dz, round(sum(CASE WHEN own THEN b ELSE 0 END) / sum(b), 6) AS w FROM m GROUP BY dx, dy, dz")
def g_weights_zung(spark, sf):
    return blend.weights(spark, 8, 4).select("dx", "dy", "dz", F.round("w", 6).alias("w"))


@query(_AXIS.format("-1 / (1 - pow((c + 1) / 9.0::DOUBLE * 2 - 1, 2))") + " SELECT dx, dy, dz, round(sum(CASE WHEN own THEN exp(l) ELSE 0 END) / sum(exp(l)), 6) AS w FROM u GROUP BY dx, dy, dz")
def g_weights_wu(spark, sf):
    return blend.weights(spark, 8, 4, "wu").select("dx", "dy", "dz", F.round("w", 6).alias("w"))


@query(G + ", c AS (SELECT z // 8 AS slab, v // 64 AS label, count(*) AS n FROM g GROUP BY ALL) SELECT CAST(slab AS int) AS slab, CAST(label AS int) AS label, round(1 / (4 * least(greatest(n / sum(n) OVER (PARTITION BY slab), 0.05), 0.95)), 6)::DOUBLE AS w FROM c")
def g_label_balance(spark, sf):
    classed = voxels(spark, sf).select(cell("z", 8).alias("slab"), cell("v", 64).alias("label"))
    return blend.label_balance(classed, "slab", 4, 8 * SIDE * SIDE).select("slab", "label", F.round("w", 6).alias("w"))


@query(V + " SELECT CAST(sum(CAST(v >= 220 AND (x + y) % 3 > 0 AS int)) AS bigint) AS inter, count(*) AS \"union\", round(sum(CAST(v >= 220 AND (x + y) % 3 > 0 AS int)) / count(*), 6) AS iou FROM v WHERE v >= 220 OR (v >= 200 AND (x + y) % 3 > 0)")
def g_iou(spark, sf):
    v = voxels(spark, sf)
    return blend.iou(v.where("v >= 200 and (x + y) % 3 > 0"), v.where("v >= 220")).select("inter", "union", F.round("iou", 6).alias("iou"))


@query(V + ", t AS (SELECT CAST(z AS int) AS i FROM v GROUP BY z) SELECT CAST(min(i * 3 - 5) AS int) AS lo_x, CAST(min(i) AS int) AS lo_y, CAST(min(-i) AS int) AS lo_z, CAST(max(i * 3 - 5 + 10) - min(i * 3 - 5) AS int) AS n_x, CAST(max(i + 20) - min(i) AS int) AS n_y, CAST(max(-i + 30) - min(-i) AS int) AS n_z FROM t")
def g_extent(spark, sf):
    i = F.col("z")
    tiles = voxels(spark, sf).select("z").distinct().select((i * 3 - 5).alias("ox"), i.alias("oy"), (-i).alias("oz"), F.lit(10).alias("nx"), F.lit(20).alias("ny"), F.lit(30).alias("nz"))
    return blend.extent(tiles)


@query(V + " SELECT CAST(x // 2 AS int) AS x, CAST(y // 2 AS int) AS y, CAST(z // 2 AS int) AS z, v FROM v WHERE x % 2 = 0 AND y % 2 = 0 AND z % 2 = 0")
def j_downsample(spark, sf):
    return voxel.downsample(voxels(spark, sf), 2)


@query(V + " SELECT CAST(x * 2 + a.range AS int) AS x, CAST(y * 2 + b.range AS int) AS y, CAST(z * 2 + c.range AS int) AS z, v FROM v, range(2) a, range(2) b, range(2) c")
def j_upsample(spark, sf):
    return voxel.upsample(voxels(spark, sf), 2)


@query(V + ", s AS (SELECT CAST(range AS int) AS n, CAST(floor((range + 0.5) * 1.5) AS int) AS o FROM range(21)) SELECT a.n AS x, b.n AS y, c.n AS z, v FROM s a, s b, s c JOIN v ON v.x = a.o AND v.y = b.o AND v.z = c.o")
def j_resample_nearest(spark, sf):
    return voxel.resample_nearest(voxels(spark, sf), LO, HI, 1.0, 1.5)


@query(V + " SELECT CAST(31 - x AS int) AS x, y, z, v FROM v")
def k_mirror(spark, sf):
    return voxel.mirror(voxels(spark, sf), "x", 0, SIDE)


@query(V + " SELECT z AS x, x AS y, y AS z, v FROM v")
def k_transpose(spark, sf):
    return voxel.transpose(voxels(spark, sf), ("z", "x", "y"))


@query(V + " SELECT CAST(x + z % 5 - 2 AS int) AS x, y, z, v FROM v WHERE x + z % 5 - 2 BETWEEN 0 AND 31")
def k_section_shift(spark, sf):
    shifts = spark.range(SIDE).select(F.col("id").cast("int").alias("z"), (F.col("id") % 5 - 2).cast("int").alias("shift"))
    return voxel.shift_sections(voxels(spark, sf), shifts, "x", 0, SIDE)


@query(G + ", m AS (SELECT z, avg(v) AS m FROM g WHERE z IN (3, 7) GROUP BY z) SELECT x, y, z, round(m + (v - m) * 0.1::DOUBLE, 12) AS v FROM g JOIN m USING (z) UNION ALL SELECT x, y, z, v::DOUBLE FROM v WHERE z NOT IN (3, 7)")
def k_lower_contrast(spark, sf):
    return voxel.lower_contrast(voxels(spark, sf), [3, 7], 0.1, LO, HI).select(*AXES, F.round("v", 12).alias("v"))


@query(V + " SELECT x, CAST(CASE WHEN y >= 13 THEN y - 3 ELSE y END AS int) AS y, z, v FROM v WHERE y < 10 OR y >= 13")
def k_drop_sections(spark, sf):
    return voxel.drop_sections(voxels(spark, sf), "y", 10, 3)


@query(G + " SELECT g.x, g.y, g.z, CAST(sum(v.v) AS double) AS p FROM g JOIN v ON v.x BETWEEN g.x - 1 AND g.x + 1 AND v.y BETWEEN g.y - 1 AND g.y + 1 AND v.z BETWEEN g.z - 1 AND g.z + 1 GROUP BY g.x, g.y, g.z HAVING sum(v.v) <> 0")
def l_model_blocks(spark, sf):
    return model.apply_model(voxels(spark, sf), model.box_filter, 8, 1).where(half_open(LO, HI))


@query()
def g_segment_accumulate(spark, sf):
    """Windows of 8 with an overlap of 4, the model's output as p, folded in window order."""
    p = model.apply_model(voxels(spark, sf), model.box_filter, 8, 1).where(half_open(LO, HI)).withColumn("p", 1 / (1 + F.exp(-(F.col("p") - 3000) / 500)))
    for a in AXES:
        first, last = F.greatest(F.floor((F.col(a) - 4) / 4), F.lit(0)), F.least(F.floor(F.col(a) / 4), F.lit(6))
        p = p.withColumn(f"w{a}", F.explode(F.sequence(first, last))).withColumn(f"w{a}", (F.col(f"w{a}") * 4).cast("int"))
    return blend.accumulate(p, blend.weights(spark, 8, 4), 8)


@query()
def i_skeletonize(spark, sf):
    return skeletons.skeletonize(cc.label_voxels(voxel.threshold(voxels(spark, sf), 225), SIDE, block=8), SIDE, chunk=16, least=10)
