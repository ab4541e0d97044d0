"""What holds operators together on larger tables: what is broadcast, what is shuffled, and results where cells are crowded."""

import numpy as np
from pyspark.sql import functions as F

from voxstrata.operators import deform, partners, reconnect, samples, spatial, trees
from voxstrata.sources.tables import swc_nodes

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(spark, n, low, high, seed=3, kind="x int, y int, z int"):
    rng = np.random.default_rng(seed)
    at = rng.integers(low, high, (n, 3))
    return [(k, *map(int, p), k % 3) for k, p in enumerate(at)]


def test_distance_pairs_of_crowded_cells(spark, monkeypatch):
    """Against brute force, with more points in a cell than one packed row has, below and above zero; no side is broadcast."""
    monkeypatch.setattr(spatial, "PACK", 7)
    rows = rows_of(spark, 150, -9, 9)
    df = spark.createDataFrame(rows, "id int, x int, y int, z int, g int")
    got = spatial.distance_pairs(df, 6, "g", carry=("x",))
    assert "Broadcast" not in plan(got)
    d2 = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4]))
    want = sorted((a[0], b[0], d2(a, b), a[1], b[1]) for a in rows for b in rows if a[0] < b[0] and a[4] != b[4] and d2(a, b) <= 36)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 500


def test_knn_of_crowded_cells(spark, monkeypatch):
    """Against brute force where cells hold more than a packed row, and points far away take several rounds; no side is broadcast."""
    monkeypatch.setattr(spatial, "PACK", 5)
    rows = rows_of(spark, 90, -3, 3) + [(k, 40 * (k - 95), -60, 7, 0) for k in range(95, 101)]
    df = spark.createDataFrame(rows, "id int, x int, y int, z int, g int").select("id", "x", "y", "z")
    found = spatial.knn(df, df, 3, same=True)
    assert "Broadcast" not in plan(found)
    got = sorted(map(tuple, found.select("id", "rank", "nn", "d2").collect()))
    want = []
    for a in rows:
        near = sorted((sum((p - q) ** 2 for p, q in zip(a[1:4], b[1:4])), b[0]) for b in rows if a[0] != b[0])[:3]
        want += [(a[0], n + 1, b, d) for n, (d, b) in enumerate(near)]
    assert got == sorted(want)


def test_best_rows_are_aggregated(spark):
    """Pairs deduped, the best of bands, and kinds, against a walk; no pair is sorted before the groups' best rows are known."""
    rng = np.random.default_rng(4)
    low = -(1 << 31)
    rows = list({(int(a), int(b)): (int(a), int(b), int(d), int(s)) for a, b, d, s in zip(rng.integers(-20, 20, 600), rng.integers(50, 90, 600), rng.integers(0, 101, 600), rng.choice([low, -7, 0, 3, (1 << 31) - 1], 600))}.values())
    df = spark.createDataFrame(rows, "id1 int, id2 int, d2 int, score int")
    first = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        first.setdefault(r[0], r)
    second = {}
    for r in sorted(first.values(), key=lambda r: (-r[3], r[0])):
        second.setdefault(r[1], r)
    pairs = trees.dedupe_pairs(df, "id1", "id2", "score")
    assert pairs.columns == df.columns and sorted(map(tuple, pairs.collect())) == sorted(second.values())
    banded = {}
    for r in sorted(rows, key=lambda r: (np.ceil(np.sqrt(r[2]) / 5), -r[3], r[1])):
        banded.setdefault(r[0], r)
    found = samples.banded_pairs(df, 5)
    assert found.columns == df.columns and sorted(map(tuple, found.collect())) == sorted(banded.values())
    assert "Window" not in plan(pairs) and "SortAggregate" not in plan(pairs) and "SortAggregate" not in plan(found)
    kinds = samples.partner_kinds(spark.createDataFrame([(k,) for k in range(-20, 91)], "id int"), df.select(F.col("id1").alias("pre"), F.col("id2").alias("post")))
    pre, post = {r[0] for r in rows}, {r[1] for r in rows}
    for r in kinds.collect():
        want = min((q[1] for q in rows if q[0] == r.id), default=None) if r.id in pre else min((q[0] for q in rows if q[1] == r.id), default=None)
        assert (r.kind, r.partner) == ("pre" if r.id in pre else "post" if r.id in post else None, want)
    assert "SortAggregate" not in plan(kinds)


def test_directions_by_tree_equal_those_by_joins(spark, monkeypatch):
    """Trees walked in one task, larger ones, one whose parent is of another tree, and a parent that isn't there."""
    rng = np.random.default_rng(6)
    rows = []
    for t in range(5):
        place = rng.integers(0, 25, 3)
        for n in range(1, 31 if t == 3 else 12):
            rows.append((100 * t + n, -1 if n == 1 else 100 * t + n - (4 if n == 9 else 1), t, *map(int, place)))
            place = place + rng.integers(-1, 3, 3)
    rows.append((900, 205, 4, 1, 2, 3))
    rows.append((901, 77777, 0, 5, 5, 5))
    df = spark.createDataFrame(rows, "id int, parent int, tree_id int, x int, y int, z int")
    ends = df.select("id").where("id % 3 <> 0")
    plain = {r.end: list(r)[1:] for r in reconnect.directions_at(df, ends, (3, 20)).collect()}
    monkeypatch.setattr(reconnect, "TREE", 20)
    monkeypatch.setattr(reconnect, "GROUP", 10)
    got = {r.end: list(r)[1:] for r in reconnect.directions_at(df, ends, (3, 20), "tree_id").collect()}
    assert set(got) == set(plain) == {r[0] for r in rows if r[0] % 3} and all(np.allclose(got[e], plain[e]) for e in plain)


def test_points_at_one_place_are_moved_once(spark):
    """Against brute force, with points that share places; no side is broadcast before it is multiplied."""
    rng = np.random.default_rng(8)
    asked = [(k, *map(int, p)) for k, p in enumerate(rng.integers(0, 4, (80, 3)))]
    sources = [(*map(int, p), *map(float, p * 0.7 + rng.integers(-1, 2, 3) * 0.3)) for p in np.argwhere(np.ones((5, 5, 5)))]
    points = spark.createDataFrame(asked, "id int, x int, y int, z int")
    mapping = spark.createDataFrame(sources, "x int, y int, z int, sx double, sy double, sz double")
    moved = deform.move_points(points, mapping, 0.6)
    assert "Broadcast" not in plan(moved)
    want = []
    for k, *p in asked:
        near = [(round(sum((a - b) ** 2 for a, b in zip(p, s[3:])), 9), s[:3]) for s in sources]
        d, at = min(near)
        want += [(k, *at)] if d <= 0.36 else []
    assert sorted(map(tuple, moved.collect())) == sorted(want) and 0 < len(want) < 80


def test_sources_at_one_place_draw_one_ball(spark, monkeypatch):
    """The smallest id that has a partner takes the place; only its ball is made."""
    drawn = []
    monkeypatch.setattr(partners, "shifted", lambda df, *a, f=partners.shifted, **k: (drawn.append(df.count()), f(df, *a, **k))[1])
    o = spark.createDataFrame([(k, 3, 3, 3) for k in range(1, 9)] + [(9, 9, 3, 3)], "id int, x int, y int, z int")
    q = spark.createDataFrame([(2, 20, 4, 3, 3), (2, 21, 3, 3, 9), (5, 50, 3, 3, 3), (9, 90, 9, 9, 9)], "id int, partner int, x int, y int, z int")
    for every in (False, True):
        got = partners.vector_map(o, q, 1.0, every=every).collect()
        assert {(r.x, r.id) for r in got} == {(x, 2) for x in (2, 3, 4)} | {(x, 9) for x in (8, 9, 10)} and len(got) == 14
        assert {r.partner for r in got} == ({20, 21, 90} if every else {20, 90})
    assert drawn == [2, 2]


def test_nodes_are_not_broadcast(spark):
    """Two columns of the nodes seem small to Spark where the table's file is; the driver would hold all of them."""
    nodes = swc_nodes(spark, SF)
    for df in (trees.parents(nodes), trees.leaves(nodes), reconnect.end_points(nodes, "tree_id")):
        assert "BroadcastHashJoin" not in plan(df)
