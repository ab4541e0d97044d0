"""Queries over pooled and aligned volumes, drawn places, graphs drawn in several ways, and radii from a segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES
from voxstrata.operators import pool, raster, voxel
from voxstrata.plans.chunk_queries import _slabs
from voxstrata.plans.registry import query
from voxstrata.plans.voxel_queries import HI, LO, G, V
from voxstrata.sources.tables import NODES, POINTS, points, swc_nodes, voxels

#: The trees' bounding boxes as volumes, and their windows of 16 x 16 x 16 places.
B = f"""WITH b AS (SELECT tree_id AS volume, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) + 1 AS x1, max(y) + 1 AS y1, max(z) + 1 AS z1 FROM ({NODES}) GROUP BY tree_id),
c AS (SELECT *, greatest((x1 - x0 - 16) // 8 + 1, 0) AS nx, greatest((y1 - y0 - 16) // 12 + 1, 0) AS ny, greatest((z1 - z0 - 16) // 10 + 1, 0) AS nz FROM b),
p AS (SELECT *, nx * ny * nz AS n, coalesce(sum(nx * ny * nz) OVER (ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM c),
w AS (SELECT CAST(first + i AS bigint) AS number, volume, CAST(x0 + i // (ny * nz) * 8 AS int) AS x0, CAST(y0 + i // nz % ny * 12 AS int) AS y0, CAST(z0 + i % nz * 10 AS int) AS z0 FROM (SELECT *, unnest(range(CAST(n AS bigint))) AS i FROM p)),
f AS (SELECT number, volume, x0, y0, z0, CAST(x0 + 16 AS int) AS x1, CAST(y0 + 16 AS int) AS y1, CAST(z0 + 16 AS int) AS z1 FROM w)"""
_SIZE, _STRIDE = (16, 16, 16), (8, 12, 10)


def _pool(spark, sf):
    ends = [f(a).alias(f"{a}{e}") if not e else (f(a) + 1).alias(f"{a}{e}") for a in AXES for e, f in ((0, F.min), (1, F.max))]
    return pool.pooled(swc_nodes(spark, sf).groupBy(F.col("tree_id").alias("volume")).agg(*ends), _SIZE, _STRIDE)


@query(B + " SELECT * FROM f")
def e_pool_windows(spark, sf):
    return pool.all_windows(_pool(spark, sf), _SIZE, _STRIDE)


@query(B + " SELECT * FROM f WHERE number IN (SELECT 3 * c_custkey FROM customer)")
def e_windows_by_number(spark, sf):
    numbers = points(spark, sf).select((F.col("id") * 3).cast("long").alias("number"))
    return pool.windows_at(numbers, _pool(spark, sf), _SIZE, _STRIDE)


@query(V + """, s AS (SELECT CAST(range * 8 AS int) AS s, range AS n FROM range(3)), w AS (SELECT a.n * 9 + b.n * 3 + c.n AS number, a.s AS x0, b.s AS y0, c.s AS z0 FROM s a, s b, s c), l AS (SELECT 'raw' AS layer, x, y, z, v FROM v UNION ALL SELECT 'label', x, y, z, v // 100 FROM v),
k AS (SELECT DISTINCT number FROM w JOIN v ON x >= x0 AND x < x0 + 16 AND y >= y0 AND y < y0 + 16 AND z >= z0 AND z < z0 + 16 WHERE v // 100 <> 0) SELECT number, layer, CAST(x - x0 AS int) AS x, CAST(y - y0 AS int) AS y, CAST(z - z0 AS int) AS z, CAST(v AS int) AS v FROM w JOIN k USING (number) JOIN l ON x >= x0 AND x < x0 + 16 AND y >= y0 AND y < y0 + 16 AND z >= z0 AND z < z0 + 16""")
def e_aligned_windows(spark, sf):
    """Two aligned layers in the overlapping windows whose labels aren't all zero."""
    v = voxels(spark, sf)
    label = v.withColumn("v", F.floor(F.col("v") / 100).cast("int"))
    one = spark.createDataFrame([(0, 0, 0, 0, 32, 32, 32)], "volume int, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    w = pool.all_windows(pool.pooled(one, (16,) * 3, (8,) * 3), (16,) * 3, (8,) * 3)
    return pool.aligned({"raw": v, "label": label}, w.join(pool.valid_windows(label, w, 16), "number"), 16)


#: SQL of pool.uniform with a seed and a key.
_U = "(('0x' || substr(md5('{}:' || {}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"SELECT id, CAST(CASE WHEN {_U.format(7, 'id')} < 0.125 THEN 0 WHEN {_U.format(7, 'id')} < 0.375 THEN 1 ELSE 2 END AS int) AS choice FROM ({POINTS})")
def e_random_provider(spark, sf):
    return pool.chosen(points(spark, sf).select("id"), "id", [1, 2, 5], 7)


@query(G + f""", m AS (SELECT x, y, z, CASE WHEN v >= 200 THEN 1 ELSE 0 END AS v FROM g), a AS (SELECT x, y, z, sum(v) OVER (PARTITION BY y, z ORDER BY x ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS n FROM m), b AS (SELECT x, y, z, sum(n) OVER (PARTITION BY x, z ORDER BY y ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS n FROM a),
c AS (SELECT x, y, z, CAST(sum(n) OVER (PARTITION BY x, y ORDER BY z ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS bigint) AS n FROM b), l AS (SELECT * FROM c WHERE x <= 26 AND y <= 27 AND z <= 28 AND n >= 120 * 0.02::DOUBLE AND n > 0)
SELECT x, y, z, n FROM l ORDER BY -ln(1 - {_U.format(3, "x || ':' || y || ':' || z")}) / n, x, y, z LIMIT 100""")
def e_drawn_locations(spark, sf):
    """A hundred boxes drawn by how much of the mask they hold."""
    mask = voxel.densify(voxels(spark, sf), LO, HI).select(*AXES, (F.col("v") >= 200).cast("int").alias("v"))
    return pool.drawn(pool.masked_locations(mask, (6, 5, 4), LO, HI, 0.02), "n", 100, 3, list(AXES))


def _spots(spark, sf):
    return points(spark, sf).select("id", *[(F.col(a) % 32).alias(a) for a in AXES])


#: The points in the grid, and each place's distance to the nearest, within 3, along z twice as far.
D = G + f""", o AS (SELECT id, x % 32 AS x, y % 32 AS y, z % 32 AS z FROM ({POINTS})),
d AS (SELECT g.x, g.y, g.z, min((g.x - o.x) * (g.x - o.x) + (g.y - o.y) * (g.y - o.y) + 4 * (g.z - o.z) * (g.z - o.z)) AS d2 FROM g JOIN o ON g.x BETWEEN o.x - 3 AND o.x + 3 AND g.y BETWEEN o.y - 3 AND o.y + 3 AND g.z BETWEEN o.z - 1 AND o.z + 1 GROUP BY g.x, g.y, g.z)"""


@query(D + " SELECT x, y, z FROM d WHERE d2 <= 9 AND sqrt(d2) > 0.6::DOUBLE * 3")
def h_raster_ring(spark, sf):
    return raster.draw(_spots(spark, sf), LO, HI, 3, ring=0.4, voxel_size=(1, 1, 2))


@query(D + """, l AS (SELECT x, y, z, CASE WHEN v >= 252 THEN 0 ELSE 1 + x // 12 END AS label FROM g), on_ AS (SELECT o.*, label FROM o JOIN l ON l.x = o.x AND l.y = o.y AND l.z = o.z WHERE label <> 0)
SELECT DISTINCT l.x, l.y, l.z FROM l JOIN on_ s ON l.label = s.label AND (l.x - s.x) * (l.x - s.x) + (l.y - s.y) * (l.y - s.y) + (l.z - s.z) * (l.z - s.z) <= 4 AND l.x BETWEEN s.x - 2 AND s.x + 2""")
def h_raster_masked(spark, sf):
    return raster.draw(_spots(spark, sf), LO, HI, 2, mask=_slabs(spark, sf))


@query(D + f""", spots AS (SELECT DISTINCT x, y, z FROM o), q AS (SELECT g.x, g.y, g.z, sum(exp(-0.5 * ((g.x - s.x) * (g.x - s.x) + (g.y - s.y) * (g.y - s.y)) / {1.5 * 1.5}::DOUBLE - 0.5 * (g.z - s.z) * (g.z - s.z) / {0.75 * 0.75}::DOUBLE)) AS v FROM g JOIN spots s ON g.x BETWEEN s.x - 6 AND s.x + 6 AND g.y BETWEEN s.y - 6 AND s.y + 6 AND g.z BETWEEN s.z - 3 AND s.z + 3 GROUP BY g.x, g.y, g.z)
SELECT x, y, z, round(v / (SELECT max(v) FROM q), 6) AS v FROM q WHERE v / (SELECT max(v) FROM q) > 0.00001""")
def h_raster_peak(spark, sf):
    return raster.peaks(_spots(spark, sf), LO, HI, 1.5, voxel_size=(1, 1, 2)).where("v > 0.00001").select(*AXES, F.round("v", 6).alias("v"))


@query(V + f""", f AS (SELECT DISTINCT x, y, z + o AS z FROM v, (VALUES (-1), (0), (1)) t(o)), n AS (SELECT id, x % 32 AS x, y % 32 AS y, z % 32 AS z FROM ({NODES})), r AS (SELECT CAST(range - 6 AS int) AS i FROM range(13)),
w AS (SELECT id, n.x + a.i AS x, n.y + b.i AS y, n.z, greatest(abs(a.i), abs(b.i)) AS ring, a.i * a.i + b.i * b.i AS d2 FROM n, r a, r b), m AS (SELECT w.*, f.x IS NOT NULL AS full_ FROM w LEFT JOIN f USING (x, y, z)),
k AS (SELECT id, min(ring) AS ring FROM m WHERE ring > 0 AND NOT full_ GROUP BY id), h AS (SELECT id FROM m WHERE full_ GROUP BY id)
SELECT id, round(sqrt(min(d2)) * 0.5::DOUBLE, 6) AS radius FROM m JOIN k USING (id, ring) WHERE NOT full_ AND id IN (SELECT id FROM h) GROUP BY id UNION ALL SELECT id, 0.1::DOUBLE FROM n WHERE id NOT IN (SELECT id FROM h)""")
def i_plane_radii(spark, sf):
    n = swc_nodes(spark, sf).select("id", *[(F.col(a) % 32).alias(a) for a in AXES])
    return raster.plane_radii(n, voxels(spark, sf), most=6, pixel=0.5).select("id", F.round("radius", 6).alias("radius"))


@query()
def i_tree_radii(spark, sf):
    """Radii of all nodes, read at every tenth and filled along the trees; tested against a walk."""
    n = swc_nodes(spark, sf).withColumns({a: F.col(a) % 32 for a in AXES})
    return raster.tree_radii(n, "tree_id", voxels(spark, sf), most=6, pixel=0.5)
