"""Deformations, vectors to partners and joined parts against numpy and sequential walks."""

import itertools
import random

import numpy as np
import pytest

from voxstrata.operators import deform, partners


def dense(df, shape, column="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.x, r.y, r.z] = r[column]
    return out


def frame(spark, a, name="v"):
    return spark.createDataFrame([(*map(int, p), int(a[tuple(p)])) for p in np.argwhere(a)], f"x int, y int, z int, {name} int")


def numpy_map(shape, control, spacing, matrix, centre):
    out = np.zeros((3, *shape))
    for p in np.ndindex(shape):
        base = [c // s for c, s in zip(p, spacing)]
        t = [c / s - b for c, s, b in zip(p, spacing, base)]
        out[(slice(None), *p)] = np.array(matrix) @ (np.array(p) - centre) + centre
        for o in itertools.product((0, 1), repeat=3):
            w = np.prod([f if d else 1 - f for f, d in zip(t, o)])
            out[(slice(None), *p)] += w * np.array(control.get(tuple(b + d for b, d in zip(base, o)), (0, 0, 0)))
    return out


@pytest.fixture(scope="module")
def warped(spark):
    rng, shape, spacing = np.random.default_rng(1), (11, 9, 8), (4, 3, 5)
    control = {p: rng.normal(0, 1, 3) for p in itertools.product(range(4), range(4), range(3)) if sum(p) % 5}
    rows = [(*p, *map(float, o)) for p, o in control.items()]
    m, c = deform.rotation(0.3, 1.1), (5.0, 4.0, 3.5)
    df = deform.coordinate_map(deform.places(spark, (0, 0, 0), shape), spark.createDataFrame(rows, "i int, j int, k int, ox double, oy double, oz double"), spacing, m, c).cache()
    return shape, df, numpy_map(shape, control, spacing, m, np.array(c))


def test_maps(warped):
    shape, df, want = warped
    for n, a in enumerate("xyz"):
        assert np.allclose(dense(df, shape, f"s{a}"), want[n])


def test_gather(spark, warped):
    shape, df, m = warped
    a = np.where(np.random.default_rng(2).random(shape) < 0.6, np.random.default_rng(3).integers(1, 200, shape), 0)
    at = lambda q: a[tuple(q)] if all(0 <= c < n for c, n in zip(q, shape)) else 0
    near, linear = np.zeros(shape), np.zeros(shape)
    for p in np.ndindex(shape):
        s = m[(slice(None), *p)]
        near[p] = at(np.floor(s + 0.5).astype(int))
        b = np.floor(s).astype(int)
        linear[p] = sum(np.prod([f if d else 1 - f for f, d in zip(s - b, o)]) * at(b + o) for o in itertools.product((0, 1), repeat=3))
    assert np.array_equal(dense(deform.gather(frame(spark, a), df, linear=False), shape), near)
    assert np.allclose(dense(deform.gather(frame(spark, a), df), shape), linear)


def test_points_move_against_the_map(spark, warped):
    shape, df, m = warped
    rng = np.random.default_rng(4)
    pts = rng.uniform(-1, 9, (40, 3))
    got = {r.id: (r.x, r.y, r.z) for r in deform.move_points(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pts)], "id int, x double, y double, z double"), df, 1.5).collect()}
    for k, p in enumerate(pts):
        d = ((m - p[:, None, None, None]) ** 2).sum(0)
        best = np.unravel_index(d.argmin(), shape)
        assert got.get(k) == (tuple(map(int, best)) if d.min() <= 1.5**2 else None)


def test_misaligned_sections(spark, warped):
    shape, df, m = warped
    shifts = spark.createDataFrame([(2, 3, -1), (5, -4, 2)], "z int, dx int, dy int")
    slip, shift = (dense(deform.misalign(df, shifts, lasting), shape, "sx") - m[0] for lasting in (False, True))
    assert np.allclose(slip, np.array([0, 0, 3, 0, 0, -4, 0, 0])) and np.allclose(shift, np.array([0, 0, 3, 3, 3, -1, -1, -1]))


def test_deskew(spark):
    a = np.zeros((3, 2, 4), int)
    a[1, 1, :] = [5, 6, 7, 8]
    for direction, want in ((-1, [13, 9, 5, 1]), (1, [1, 5, 9, 13])):
        assert sorted((r.z, r.x) for r in deform.deskew(frame(spark, a), 4, direction=direction).collect()) == list(enumerate(want))


def test_vectors_to_every_partner(spark):
    """Against the walk from the farthest partner to the nearest."""
    rng = random.Random(3)
    sources = {k: tuple(rng.randrange(14) for _ in range(3)) for k in range(12)}
    ends = {(k, 10 * k + n): tuple(rng.randrange(14) for _ in range(3)) for k in sources if k % 4 for n in range(1 + k % 4)}
    o = spark.createDataFrame([(k, *p) for k, p in sources.items()], "id int, x int, y int, z int")
    q = spark.createDataFrame([(*k, *p) for k, p in ends.items()], "id int, partner int, x int, y int, z int")
    mask = {p: 1 + (p[0] > 7) for p in itertools.product(range(14), repeat=3) if rng.random() < 0.9}
    objects = spark.createDataFrame([(*p, v) for p, v in mask.items()], "x int, y int, z int, label int")
    d2 = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    for objs in (None, objects):
        owner = {}
        for p in itertools.product(range(-4, 19), repeat=3):
            near = [(d2(p, s), k) for k, s in sources.items() if k % 4 and d2(p, s) <= 9 and (objs is None or (p in mask and mask.get(s) == mask[p]))]
            if near:
                owner.setdefault(min(near)[1], []).append(p)
        nearest, shared = {}, {}
        for k, ps in owner.items():
            to = sorted(((d2(sources[k], e), n, e) for (i, n), e in ends.items() if i == k))
            nearest |= {p: (k, to[0][1]) for p in ps}
            left, even = sorted(ps), len(ps) // len(to)
            for t, (_, n, e) in enumerate(sorted(to, key=lambda x: (-x[0], x[1]))):
                mine = sorted(left, key=lambda p: (d2(p, e), p))[: even if t < len(to) - 1 else None]
                shared |= {p: (k, n) for p in mine}
                left = [p for p in left if p not in set(mine)]
        for every, want in ((False, nearest), (True, shared)):
            rows = partners.vector_map(o, q, 3.0, objs, every=every).collect()
            assert {(r.x, r.y, r.z): (r.id, r.partner) for r in rows} == want
            assert all(tuple(np.add((r.x, r.y, r.z), (r.vx, r.vy, r.vz))) == ends[r.id, r.partner] for r in rows)


def test_matching_equals_the_greedy_walk(spark):
    rng = random.Random(6)
    pairs = [(a, b, rng.randrange(12), k) for k in range(300) for a, b in [(rng.randrange(60), rng.randrange(60))]] + [(100 + k, 101 + k, k, 0) for k in range(15)]
    got = {(r.a, r.b, r.d2) for r in partners.greedy_matching(spark.createDataFrame(pairs, "a int, b int, d2 int, k int"), ["d2"]).collect()}
    used, want = set(), set()
    for a, b, d2, _ in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a != b and a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, d2))
    assert got == want


def test_parts_join_at_their_nearest_ends(spark):
    ends = [(1, 0, 1, 0, 0, 0), (1, 0, 2, 9, 0, 0), (2, 1, 3, 10, 0, 0), (2, 1, 4, 20, 0, 0), (3, 2, 5, 8, 1, 0), (4, 1, 6, 20, 0, 1), (5, 0, 7, 40, 0, 0)]
    df = spark.createDataFrame(ends, "part int, chunk int, id int, x int, y int, z int")
    assert {(r.a, r.b, r.u, r.v, r.d2) for r in partners.join_parts(df, 3).collect()} == {(1, 2, 2, 3, 1)}
    assert {(r.a, r.b) for r in partners.near_ends(df, 3).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert partners.join_parts(df.limit(0), 3).count() == 0
