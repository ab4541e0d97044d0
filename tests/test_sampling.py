"""Pools of windows, draws, drawn graphs and plane radii, against sequential counts."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.operators import pool, raster


def test_pool_numbers_every_window(spark, monkeypatch):
    monkeypatch.setattr(pool, "STRETCH", 5)
    size, stride = (4, 3, 2), (2, 3, 1)
    boxes = [(7 * k % 11, k, 0, k % 3, k + 3 + k % 5, 2 + k % 7, k % 3 + 2 * (k % 4)) for k in range(11)]
    df = spark.createDataFrame(boxes, "volume int, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    want = []
    for v, *b in sorted(boxes):
        steps = [range(0, max(0, b[3 + k] - b[k] - size[k]) + 1, stride[k]) if b[3 + k] - b[k] >= size[k] else [] for k in range(3)]
        want += [(v, *(low + s for low, s in zip(b, at)), *(low + s + n for low, s, n in zip(b, at, size))) for at in itertools.product(*steps)]
    p = pool.pooled(df, size, stride)
    got = sorted(map(tuple, pool.all_windows(p, size, stride).collect()))
    assert got == [(n, *w) for n, w in enumerate(want)] and len(want) > 20
    asked = spark.createDataFrame([(n,) for n in (0, 3, len(want) - 1, len(want), 10**6)], "number long")
    assert sorted(map(tuple, pool.windows_at(asked, p, size, stride).collect())) == [(n, *want[n]) for n in (0, 3, len(want) - 1)]
    assert pool.all_windows(pool.pooled(df.limit(0), size, stride), size, stride).count() == 0


def test_aligned_layers(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (9, 7, 8))
    rows = [(*map(int, p), int(a[tuple(p)])) for p in np.argwhere(a)]
    df = spark.createDataFrame(rows, "x int, y int, z int, v int")
    w = spark.createDataFrame([(5, 1, 0, 2, 6, 4, 7), (6, 4, 3, 3, 9, 7, 8)], "number long, x0 int, y0 int, z0 int, x1 int, y1 int, z1 int")
    got = pool.aligned({"a": df, "b": df.where("v = 2")}, w, 3).collect()
    for number, cut in ((5, a[1:6, 0:4, 2:7]), (6, a[4:9, 3:7, 3:8])):
        for layer, values in (("a", cut), ("b", np.where(cut == 2, 2, 0))):
            found = np.zeros_like(cut)
            for r in got:
                if (r.number, r.layer) == (number, layer):
                    found[r.x, r.y, r.z] = r.v
            assert np.array_equal(found, values)
    few = df.where("x < 2 and v = 1")
    assert {r.number for r in pool.valid_windows(few, w, 3).collect()} == {5}


def test_draws_follow_their_shares(spark):
    keys = spark.range(20_000)
    counts = Counter(r.choice for r in pool.chosen(keys, "id", [1, 2, 5], 3).collect())
    assert all(abs(counts[k] / 20_000 - s) < 0.012 for k, s in enumerate((0.125, 0.25, 0.625)))
    rows = keys.withColumn("w", F.when(F.col("id") < 10_000, 1.0).when(F.col("id") < 19_000, 3.0).otherwise(0.0))
    got = [r.id for r in pool.drawn(rows, "w", 2000, 5, ["id"]).collect()]
    assert got == [r.id for r in pool.drawn(rows.repartition(7), "w", 2000, 5, ["id"]).collect()]
    assert len(set(got)) == 2000 and max(got) < 19_000
    assert abs(sum(k >= 10_000 for k in got) / 2000 - 0.71) < 0.05  # 27 of 37 at first, a little less as weights run out
    assert pool.drawn(rows.where("id < 5"), "w", 50, 5, ["id"]).count() == 5


def test_masked_locations(spark):
    a = (np.random.default_rng(2).random((7, 6, 8)) < 0.3).astype(int)
    rows = spark.createDataFrame([(*map(int, p), int(a[p])) for p in np.ndindex(a.shape)], "x int, y int, z int, v int")
    got = {(r.x, r.y, r.z): r.n for r in pool.masked_locations(rows, (3, 2, 4), (0, 0, 0), a.shape, 0.25).collect()}
    want = {p: int(a[p[0] : p[0] + 3, p[1] : p[1] + 2, p[2] : p[2] + 4].sum()) for p in np.ndindex(5, 5, 5)}
    assert got == {p: n for p, n in want.items() if n >= 6}


def graph(spark):
    nodes = [(1, 3, 3, 3), (2, 9, 4, 5), (3, 4, 10, 9), (4, 11, 11, 2)]
    return nodes, spark.createDataFrame(nodes, "id int, x int, y int, z int"), spark.createDataFrame([(1, 2), (3, 1)], "u int, v int")


def places(rows):
    return {(r.x, r.y, r.z) for r in rows.collect()}


@pytest.mark.parametrize("ring", [None, 0.4])
@pytest.mark.parametrize("masked", [False, True])
def test_drawn_graphs(spark, ring, masked):
    nodes, df, edges = graph(spark)
    size, radius, box = (1, 1, 2), 3.0, list(np.ndindex(13, 13, 11))
    lines = places(raster.line_places(df, edges))
    assert {(3, 3, 3), (9, 4, 5), (4, 10, 9)} <= lines and len(lines) == 7 + 8 - 1
    mask = {p: 0 if p[2] == 8 else 1 + (p[0] > 6) for p in box}
    mask[11, 11, 2] = 7  # a label of which only the node's own place is there
    d = lambda a, b: math.sqrt(sum(((s - t) * k) ** 2 for s, t, k in zip(a, b, size)))
    want = set()
    for p in box:
        seeds = lines | {n[1:] for n in nodes}
        if masked:
            if mask[p] == 0 or mask[p] not in {mask[n[1:]] for n in nodes}:
                continue
            seeds = lines | {n[1:] for n in nodes if mask[n[1:]] == mask[p]}
        near = min(d(p, s) for s in seeds)
        if near <= radius and (ring is None or near > (1 - ring) * radius):
            want.add(p)
    m = spark.createDataFrame([(*p, v) for p, v in mask.items()], "x int, y int, z int, label int") if masked else None
    assert places(raster.draw(df, (0, 0, 0), (13, 13, 11), radius, edges, ring, m, size)) == want


def test_peaks(spark):
    nodes, df, edges = graph(spark)
    size, radius, shape = (1, 1, 2), 1.5, (13, 13, 11)
    half = [int(4 * radius / s + 0.5) for s in size]
    for with_edges in (False, True):
        seeds = {n[1:] for n in nodes} | (places(raster.line_places(df, edges)) if with_edges else set())
        a = np.zeros(shape)
        for p in np.ndindex(shape):
            a[p] = sum(math.exp(-0.5 * sum(((x - y) * k / radius) ** 2 for x, y, k in zip(p, s, size))) for s in seeds if all(abs(x - y) <= h for x, y, h in zip(p, s, half)))
        a /= a.max()
        got = np.zeros(shape)
        for r in raster.peaks(df, (0, 0, 0), shape, radius, edges if with_edges else None, voxel_size=size).collect():
            got[r.x, r.y, r.z] = r.v
        assert np.allclose(got, a)
    mask = spark.createDataFrame([(*p, 1 + (p[0] > 6)) for p in np.ndindex(shape)], "x int, y int, z int, label int")
    rows = raster.peaks(df, (0, 0, 0), shape, radius, mask=mask, voxel_size=size).collect()
    assert max(r.v for r in rows if r.x <= 6) == 1 and max(r.v for r in rows if r.x > 6) == 1
    with pytest.raises(ValueError):
        raster.peaks(df, (0, 0, 0), shape, radius, edges, mask)


def test_plane_radii_and_trees(spark):
    rng = np.random.default_rng(3)
    filled = {(x, y, z) for x, y, z in np.ndindex(16, 16, 4) if (x - 6) ** 2 + (y - 7) ** 2 <= 30 or rng.random() < 0.2}
    nodes = [(k, k - 1 if k > 1 else -1, 0, int(rng.integers(0, 16)), int(rng.integers(0, 16)), int(rng.integers(0, 4))) for k in range(1, 60)] + [(99, -1, 1, 500, 500, 1)]
    flat = lambda x, y, z: any((x, y, z + o) in filled for o in (-1, 0, 1))

    def radius(x, y, z, most):
        if not any(flat(x + i, y + j, z) for i in range(-most, most + 1) for j in range(-most, most + 1)):
            return 0.1
        for r in range(1, most + 1):
            gaps = [i * i + j * j for i in range(-r, r + 1) for j in range(-r, r + 1) if max(abs(i), abs(j)) == r and not flat(x + i, y + j, z)]
            if gaps:
                return math.sqrt(min(gaps)) * 2.0
        return None

    df = spark.createDataFrame(nodes, "id int, parent int, tree_id int, x int, y int, z int")
    seg = spark.createDataFrame([tuple(map(int, p)) for p in filled], "x int, y int, z int")
    for most in (3, 12):
        got = {r.id: r.radius for r in raster.plane_radii(df, seg, most, pixel=2.0).collect()}
        assert got == pytest.approx({k: v for k, _, _, *p in nodes if (v := radius(*p, most)) is not None})
    filled_in = {r.id: r.radius for r in raster.tree_radii(df, "tree_id", seg, most=12, pixel=2.0).collect()}
    read = {k: radius(*p, 12) for k, up, _, *p in nodes if k % 10 == 0 or up == -1}
    for k, *_ in nodes[:-1]:
        near = min(read.keys() - {99}, key=lambda j: (abs(j - k), j > k))
        assert filled_in[k] == pytest.approx(read[near])
    assert filled_in[99] == 0.1
