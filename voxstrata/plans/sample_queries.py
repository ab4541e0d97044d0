"""Queries over training-side operators and the composed commands."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES
from voxstrata.functions.shared import shared_dir
from voxstrata.operators import samples, spatial, tiling, voxel
from voxstrata.plans import commands
from voxstrata.plans.geometry_queries import _D2, B
from voxstrata.plans.registry import query
from voxstrata.plans.skeleton_queries import A, T
from voxstrata.plans.voxel_queries import _ZUNG, HI, LO, SIDE, G, V, _cc
from voxstrata.sources import chunked
from voxstrata.sources.tables import POINTS, points, swc_nodes, voxels


@query(V + " SELECT CAST(x // 8 AS int) AS bx, CAST(y // 8 AS int) AS by, CAST(z // 8 AS int) AS bz, count(*) / 512.0::DOUBLE AS share FROM v WHERE v >= 128 GROUP BY ALL HAVING count(*) / 512.0 > 0.1")
def d_accepted_blocks(spark, sf):
    return samples.accepted_blocks(voxel.threshold(voxels(spark, sf), 128), 8, 0.1)


@query(B + ", c AS (SELECT id, CAST(round_even((x - 10) / 4.0, 0) * 4 AS int) AS x0, CAST(round_even((y - 10) / 4.0, 0) * 4 AS int) AS y0, CAST(round_even((z - 10) / 4.0, 0) * 4 AS int) AS z0 FROM p) SELECT id, x0, x0 + 20 AS x1, y0, y0 + 20 AS y1, z0, z0 + 20 AS z1 FROM c WHERE least(x0, y0, z0) >= 0 AND greatest(x0, y0, z0) + 20 <= 96")
def e_location_boxes(spark, sf):
    return samples.location_boxes(points(spark, sf), 20, 4, (0, 0, 0), (96, 96, 96))


@query(B + f", n AS (SELECT a.id, count(b.id) AS n FROM p a LEFT JOIN p b ON a.id <> b.id AND {_D2} <= 100 GROUP BY a.id) SELECT id, round(1 / (1.0::DOUBLE + n), 6) AS w FROM n")
def e_point_weights(spark, sf):
    p = points(spark, sf)
    return samples.point_weights(p, spatial.distance_pairs(p, 10)).select("id", F.round("w", 6).alias("w"))


@query(G + ", m AS (SELECT z, avg(v) AS m FROM g GROUP BY z) SELECT x, y, z, round(least(greatest(m + (v - m) * 1.2::DOUBLE - 10, 0), 255), 11) AS v FROM g JOIN m USING (z)")
def k_intensity(spark, sf):
    return samples.intensity(voxels(spark, sf), 1.2, -10.0, 0.0, 255.0, LO, HI).select(*AXES, F.round("v", 11).alias("v"))


@query(V + ", q AS (SELECT least(greatest(v / 255.0::DOUBLE, 1e-7), 1 - 1e-7) AS p, CAST(v >= 128 AS int) AS y FROM v) SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM q")
def l_cross_entropy(spark, sf):
    pairs = voxels(spark, sf).select((F.col("v") / 255.0).alias("p"), (F.col("v") >= 128).cast("int").alias("y"))
    return samples.binary_cross_entropy(pairs).select(F.round("loss", 6).alias("loss"))


@query(B + f", q AS (SELECT a.id AS pre, b.id AS post FROM p a JOIN p b ON a.id < b.id AND {_D2} <= 25), u AS (SELECT pre AS id, 'pre' AS kind, post AS partner FROM q UNION ALL SELECT post, 'post', pre FROM q) SELECT p.id, min(kind) AS kind, coalesce(min(partner), -1) AS partner FROM p LEFT JOIN u ON u.id = p.id GROUP BY p.id")
def a_partner_kinds(spark, sf):
    p = points(spark, sf)
    kinds = samples.partner_kinds(p, spatial.distance_pairs(p, 5).select(F.col("id1").alias("pre"), F.col("id2").alias("post")))
    return kinds.select("id", "kind", F.coalesce("partner", F.lit(-1)).alias("partner"))


@query(V + ", m AS (SELECT x, y, z, v // 64 AS l FROM v), i AS (SELECT CAST(range - 2 AS int) AS d FROM range(5)), s AS (SELECT x + a.d AS x, y + b.d AS y, z + c.d AS z, l, (x * 32 + y) * 32 + z AS id FROM m, i a, i b, i c WHERE a.d * a.d + b.d * b.d + c.d * c.d <= 4) SELECT m.x, m.y, m.z, CAST(min(s.id) AS int) AS id FROM s JOIN m USING (x, y, z, l) GROUP BY m.x, m.y, m.z")
def h_stamps(spark, sf):
    mask = voxels(spark, sf).select(*AXES, F.floor(F.col("v") / 64).alias("v"))
    key = (F.col("x") * SIDE + F.col("y")) * SIDE + F.col("z")
    return samples.stamps(mask.select(key.alias("id"), *AXES), mask, 2, SIDE)


@query(T + " SELECT id, x + 2.0::DOUBLE * y AS x, y - 1.0::DOUBLE * z AS y, 0.5::DOUBLE * z AS z FROM t")
def c_affine(spark, sf):
    return samples.affine(swc_nodes(spark, sf).select("id", *AXES), [[1, 2, 0], [0, 1, -1], [0, 0, 0.5]])


@query(T + ", k AS (SELECT * FROM t WHERE NOT (x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 20 AND z BETWEEN 0 AND 64)) SELECT id, tree_id, CASE WHEN parent <> -1 AND parent NOT IN (SELECT id FROM k) THEN -1 ELSE parent END AS parent, CAST(x + 5 AS int) AS x, CAST(y - 3 AS int) AS y, z FROM k WHERE tree_id IN (SELECT tree_id FROM k GROUP BY tree_id HAVING count(*) > 1)")
def d_remove_and_move(spark, sf):
    return samples.remove_and_move(swc_nodes(spark, sf), "tree_id", (0, 0, 0), (20, 20, 64), (5, -3, 0)).select("id", "tree_id", "parent", *AXES)


@query(V + " SELECT x, y, CAST(z + (x + y) % 4 AS int) AS z, v FROM v")
def f_surface_fuse(spark, sf):
    v = voxels(spark, sf)
    return samples.surface_fuse(v, v.select("x", "y").distinct().withColumn("s", (F.col("x") + F.col("y")) % 4 - 7))


@query(A + """, r AS (SELECT id, tree_id, CASE WHEN id % 10 = 3 THEN radius::DOUBLE END AS r FROM t), m AS (SELECT tree_id, avg(r) AS mean FROM r GROUP BY tree_id),
u AS (SELECT a.id, min(k) AS steps, arg_min(r, k) AS r FROM a JOIN r ON r.id = a.up WHERE r IS NOT NULL GROUP BY a.id),
d AS (SELECT a.up AS id, min(k) AS steps, arg_min(r, k * 1000000::bigint + r.id) AS r FROM a JOIN r ON r.id = a.id WHERE r IS NOT NULL GROUP BY a.up)
SELECT r.id, coalesce(r.r, CASE WHEN d.steps IS NULL OR u.steps <= d.steps THEN u.r END, d.r, u.r, mean, 0.1) AS value FROM r JOIN m USING (tree_id) LEFT JOIN u ON u.id = r.id LEFT JOIN d ON d.id = r.id""")
def i_filled_from_tree(spark, sf):
    n = swc_nodes(spark, sf).withColumn("r", F.when(F.col("id") % 10 == 3, F.col("radius")).cast("double"))
    return samples.filled_from_tree(n, "tree_id", "r", 0.1)


@query(B + f", q AS (SELECT a.id AS id1, b.id AS id2, {_D2} AS d2, (a.id * 7 + b.id * 3) % 101 AS score FROM p a JOIN p b ON a.id < b.id AND a.g <> b.g AND {_D2} <= 100) SELECT id1, id2, d2, CAST(score AS int) AS score FROM q QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY ceil(sqrt(d2) / 5), score DESC, id2) = 1")
def i_banded_pairs(spark, sf):
    pairs = spatial.distance_pairs(points(spark, sf), 10, "g").withColumn("score", (F.col("id1") * 7 + F.col("id2") * 3) % 101)
    return samples.banded_pairs(pairs, 5)


@query(V + ", m AS (SELECT max(v) + 1 AS top FROM v) SELECT 0 AS pass, x, y, z, CASE WHEN v % 7 = 0 THEN top ELSE v END AS label FROM v, m UNION ALL SELECT 1, x, y, z, v FROM v")
def c_malis_passes(spark, sf):
    v = voxels(spark, sf)
    return samples.malis_passes(v, v.where("v % 7 = 0"))


@query(V + ", t AS (SELECT 0 AS k, 0 AS dx, 0 AS dy UNION ALL SELECT 1, 10, 10), f AS (SELECT CAST(x + dx AS int) AS x, CAST(y + dy AS int) AS y, z, v, k FROM v, t WHERE v >= 100) SELECT x, y, z, arg_max(v, k) AS v FROM f GROUP BY x, y, z")
def g_fuse_overwrite(spark, sf):
    tile = voxels(spark, sf).where("v >= 100")
    return commands.fuse([(tile, (0, 0, 0)), (tile, (10, 10, 0))])


@query(V + ", t AS (SELECT 0 AS k, 0 AS dx, 0 AS dy UNION ALL SELECT 1, 10, 10), f AS (SELECT CAST(x + dx AS int) AS x, CAST(y + dy AS int) AS y, z, v, k FROM v, t WHERE v >= 100) SELECT x, y, z, max(v) AS v FROM f GROUP BY x, y, z")
def g_fuse_command(spark, sf):
    tile = voxels(spark, sf).where("v >= 100")
    return commands.fuse([(tile, (0, 0, 0)), (tile, (10, 10, 0))], "max")


_WINDOWS = """, i AS (SELECT CAST(range AS int) AS i FROM range(7)), w AS (SELECT g.x, g.y, g.z, g.v, a.i * 4 AS wx, b.i * 4 AS wy, c.i * 4 AS wz FROM g, i a, i b, i c WHERE g.x >= a.i * 4 AND g.x < a.i * 4 + 8 AND g.y >= b.i * 4 AND g.y < b.i * 4 + 8 AND g.z >= c.i * 4 AND g.z < c.i * 4 + 8),
q AS (SELECT wx, wy, wz, quantile_cont(v::DOUBLE, [0.05, 0.95]) AS q FROM w GROUP BY ALL),
n AS (SELECT dx, dy, dz, sum(CASE WHEN own THEN b ELSE 0 END) / sum(b) AS weight FROM m GROUP BY dx, dy, dz),
h AS (SELECT x, y, z, least(greatest((w.v - q[1]) * CASE WHEN q[2] > q[1] THEN 1 / (q[2] - q[1]) ELSE 1 END, 0), 1) AS share, weight FROM w JOIN q USING (wx, wy, wz) JOIN n ON dx = x - wx AND dy = y - wy AND dz = z - wz)
SELECT x, y, z, CAST(floor(sum(share * 255 * weight) / sum(weight) + 1e-9) AS int) AS v FROM h JOIN v USING (x, y, z) GROUP BY x, y, z"""


@query(G + ", " + _ZUNG.removeprefix("WITH ") + _WINDOWS)
def g_equalize_command(spark, sf):
    return commands.equalize(voxels(spark, sf), SIDE, 8, 0.05, 0.95)


@query()
def g_segment_command(spark, sf):
    return commands.segment(voxels(spark, sf), SIDE, 8)


@query()
def i_skeletonize_command(spark, sf):
    return commands.skeletonize(voxels(spark, sf), SIDE, 225, 5, 2, chunk=16)


@query(_cc("SELECT x, y, z, 1 AS c FROM v WHERE v >= 240") + f""", p AS (SELECT id, CAST(x % 32 AS int) AS x, CAST(y % 32 AS int) AS y, CAST(z % 32 AS int) AS z FROM ({POINTS})),
b AS (SELECT label FROM l GROUP BY label HAVING count(*) >= 3), m AS (SELECT * FROM l WHERE label IN (SELECT label FROM b) AND label IN (SELECT label FROM l JOIN p USING (x, y, z)))
SELECT a.x, a.y, a.z, arg_min(b.id, ({_D2}) * 1000000::bigint + b.id) AS id FROM m a, p b GROUP BY a.x, a.y, a.z""")
def g_relabel_command(spark, sf):
    p = points(spark, sf).select("id", *[(F.col(a) % SIDE).cast("int").alias(a) for a in AXES])
    return commands.relabel(voxels(spark, sf), p, SIDE, 240, 3)


@query(V + ", c AS (SELECT CAST(x // 8 AS int) AS bx, count(*) AS n FROM v GROUP BY ALL) SELECT bx, n FROM c")
def e_block_counts(spark, sf):
    return tiling.block_counts(voxels(spark, sf), 8, ("x",))


def _stored(spark, sf, **options):
    path = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}"
    chunked.write_array(voxels(spark, sf), chunked.Array(path=path, shape=(SIDE,) * 3, chunks=(10, 16, 12), dtype="<u2", **options)).count()
    return path


@query(V + " SELECT x, y, z, CAST(v AS bigint) AS v FROM v WHERE v <> 0")
def a_array_round_trip(spark, sf):
    return chunked.read_array(spark, _stored(spark, sf, version=2, codec="gzip"))


@query(V + " SELECT x, y, z, CAST(v AS bigint) AS v FROM v WHERE v <> 0 AND x >= 5 AND x < 21 AND y >= 16 AND z >= 3 AND z < 31")
def a_array_box(spark, sf):
    return chunked.read_array(spark, _stored(spark, sf, version=3, codec="zstd", separator="/"), lo=(5, 16, 3), hi=(21, 40, 31))


@query(V + " SELECT x, y, z, CAST(v AS bigint) AS v FROM v WHERE v <> 0 AND z >= 7")
def b_array_n5(spark, sf):
    """A round trip through an N5 container, with blocks that the extent cuts."""
    path = f"{shared_dir(spark)}/n5-{uuid.uuid4().hex}"
    chunked.write_array(voxels(spark, sf), chunked.Array(path, chunked.N5, (SIDE,) * 3, (10, 16, 12), ">i2", "gzip")).count()
    return chunked.read_array(spark, path, lo=(0, 0, 7))


@query(V + " SELECT x, y, z, CAST(v AS bigint) AS v FROM v WHERE v <> 0")
def b_array_filled(spark, sf):
    """A round trip where chunks that aren't there would be sevens."""
    path = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}"
    chunked.write_array(voxels(spark, sf), chunked.Array(path, 2, (SIDE,) * 3, (10, 16, 12), "<i4", "zstd", fill=7)).count()
    return chunked.read_array(spark, path)


@query(
    V
    + """, a AS (SELECT x - 3 AS x, y - 2 AS y, z AS z, v FROM v WHERE x >= 3 AND x < 31 AND y >= 2 AND z < 27),
b AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, floor(sum(v) / 8) AS v FROM a GROUP BY ALL), c AS (SELECT x // 2 AS x, y // 2 AS y, z // 2 AS z, floor(sum(v) / 8) AS v FROM b WHERE x < 14 AND y < 15 AND z < 13 GROUP BY ALL)
SELECT 1 AS scale, CAST(x AS int) AS x, CAST(y AS int) AS y, CAST(z AS int) AS z, CAST(v AS bigint) AS v FROM b WHERE v <> 0 AND x < 14 AND y < 15 AND z < 13
UNION ALL SELECT 2, CAST(x AS int), CAST(y AS int), CAST(z AS int), CAST(v AS bigint) FROM c WHERE v <> 0 AND x < 7 AND y < 7 AND z < 6"""
)
def b_precomputed(spark, sf):
    """The second and third scale of a cutout, as read back."""
    path = f"{shared_dir(spark)}/scales-{uuid.uuid4().hex}"
    chunked.write_precomputed(voxels(spark, sf), path, (SIDE,) * 3, (8, 8, 8), scales=3, cutout=((3, 2, 0), (31, 32, 27))).count()
    both = [chunked.read_precomputed(spark, path, n).withColumn("scale", F.lit(n)) for n in (1, 2)]
    return both[0].unionByName(both[1]).select("scale", *AXES, "v")


@query(V + ", w AS (SELECT CAST(x // 10 AS int) AS cx, CAST(y // 16 AS int) AS cy, CAST(z // 12 AS int) AS cz, count(*) AS n FROM v WHERE v <> 0 GROUP BY ALL) SELECT * FROM w")
def b_array_chunks(spark, sf):
    """What a sink wrote: its chunks by number."""
    path = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}"
    out = chunked.write_array(voxels(spark, sf), chunked.Array(path, 3, (SIDE,) * 3, (10, 16, 12), "<i4", separator="/"))
    at = F.split(F.regexp_extract("path", "/c/(.*)$", 1), "/")
    return out.select(*[at[k].cast("int").alias(f"c{a}") for k, a in enumerate(AXES)], "n")
