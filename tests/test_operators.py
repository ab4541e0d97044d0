"""Operators against numpy, and cases at the edges."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.functions.boxes import closed, half_open
from voxstrata.operators import blend, cc, model, morphology, reconnect, samples, skeletons, spatial, store, tiling, trees, voxel
from voxstrata.sources import chunked, files


def frame(spark, a):
    at = np.nonzero(a)
    rows = [(int(x), int(y), int(z), int(v)) for x, y, z, v in zip(*at, a[at])]
    return spark.createDataFrame(rows, "x int, y int, z int, v int")


def dense(df, shape, column="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.x, r.y, r.z] = r[column]
    return out


def brute_labels(a):
    """Labels by flood fill: the smallest linear index of each 6-connected component."""
    out, n = {}, a.shape
    for p in map(tuple, np.argwhere(a)):
        if p in out:
            continue
        todo, seen = [p], {p}
        while todo:
            q = todo.pop()
            for k, s in itertools.product(range(3), (-1, 1)):
                r = tuple(q[i] + s * (i == k) for i in range(3))
                if all(0 <= c < m for c, m in zip(r, n)) and a[r] and r not in seen:
                    seen.add(r)
                    todo.append(r)
        low = min((x * n[1] + y) * n[2] + z for x, y, z in seen)
        out |= dict.fromkeys(seen, low)
    return out


@pytest.mark.parametrize("block", [2, 3, 8])
def test_labels_do_not_depend_on_blocks(spark, block):
    a = np.random.default_rng(3).random((8, 8, 8)) < 0.4
    got = {(r.x, r.y, r.z): r.label for r in cc.label_voxels(frame(spark, a), 8, block=block).collect()}
    assert got == brute_labels(a)


def test_component_across_blocks_and_single_voxel(spark):
    a = np.zeros((8, 8, 8), int)
    a[3:5, 3:5, 3:5] = 1
    assert {r.label for r in cc.label_voxels(frame(spark, a), 8, block=4).collect()} == {(3 * 8 + 3) * 8 + 3}
    b = np.zeros((8, 8, 8), int)
    b[1, 2, 3] = 1
    one = cc.label_voxels(frame(spark, b), 8, block=4)
    assert cc.remove_small(one, 10).count() == 1  # the only component stays however small
    assert cc.label_voxels(frame(spark, b * 0), 8, block=4).count() == 0


def test_graph_components_of_a_chain_and_loops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in cc.graph_components(e).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}


def test_percentile_stretch(spark):
    a = np.random.default_rng(1).integers(0, 200, (8, 8, 8)) * (np.random.default_rng(2).random((8, 8, 8)) < 0.7)
    got = dense(voxel.percentile_stretch(frame(spark, a), 4, 0.05, 0.9), a.shape)
    want = np.zeros(a.shape)
    for i, j, k in itertools.product((0, 4), repeat=3):
        s = np.s_[i : i + 4, j : j + 4, k : k + 4]
        p1, p2 = np.percentile(a[s], [5, 90])
        want[s] = np.trunc(np.clip((a[s] - p1) / (p2 - p1), 0, 1) * 255)
    assert np.abs(got - want * (a > 0)).max() <= 1
    flat = np.full((4, 4, 4), 7)
    assert set(dense(voxel.percentile_stretch(frame(spark, flat), 4), flat.shape).ravel()) == {0}


def test_lut_rounds_half_to_even(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 3, 5, 510, 600)], "v int").select(voxel.lut(F.col("v"), 510).alias("r"))
    assert [r.r for r in df.collect()] == [0, 0, 2, 2, 255, 255]


def test_weights_sum_to_one(spark):
    w = {(r.dx, r.dy, r.dz): r.w for r in blend.weights(spark, 4, 2).collect()}
    for p in itertools.product(range(2), repeat=3):
        assert abs(sum(w[tuple(c + 2 * o for c, o in zip(p, s))] for s in itertools.product(range(2), repeat=3)) - 1) < 1e-9


def test_tiles_cover_and_halo(spark):
    seen = np.zeros((10, 7, 5), int)
    for t in tiling.tile_grid(spark, (10, 7, 5), 4).collect():
        seen[t.x0 : t.x1, t.y0 : t.y1, t.z0 : t.z1] += 1
    assert (seen == 1).all()
    with pytest.raises(ValueError):
        voxel.crop_fraction((0,), (10,), (0.5,), (0.5,))


def test_boxes_touching_at_a_face(spark):
    p = spark.createDataFrame([(2, 0, 0)], "x int, y int, z int")
    assert p.where(closed((0, 0, 0), (2, 2, 2))).count() == 1
    assert p.where(half_open((0, 0, 0), (2, 2, 2))).count() == 0
    b = lambda i, lo, hi: (i, *lo, *hi)
    schema = "i int, min_x int, min_y int, min_z int, max_x int, max_y int, max_z int"
    one = spark.createDataFrame([b(1, (0, 0, 0), (5, 5, 5))], schema)
    two = spark.createDataFrame([b(1, (5, 5, 5), (9, 9, 9)), b(2, (6, 0, 0), (9, 9, 9))], schema.replace("i int", "j int", 1))
    assert [(r.i, r.j) for r in spatial.boxes_overlap(one, two, "i", "j", 3).collect()] == [(1, 1)]


def test_knn_far_apart_and_ties(spark):
    p = spark.createDataFrame([(1, 0, 0, 0), (2, 500, 0, 0), (3, 0, 2, 0), (4, 0, -2, 0)], "id int, x int, y int, z int")
    got = {(r.id, r.rank): r.nn for r in spatial.knn(p, p, 2, same=True).collect()}
    assert got[1, 1] == 3 and got[1, 2] == 4 and got[2, 1] == 1 and got[2, 2] == 3


def test_model_halo_equals_whole_volume(spark):
    a = np.random.default_rng(5).integers(1, 9, (9, 6, 7))
    got = dense(model.apply_model(frame(spark, a), model.box_filter, 4, 1).where("x < 9 and y < 6 and z < 7 and x >= 0 and y >= 0 and z >= 0"), a.shape, "p")
    assert (got == model.box_filter(a.astype(float))).all()


def test_skeleton_of_a_line(spark):
    a = np.zeros((20, 3, 3), int)
    a[:, 1, 1] = 1
    rows = skeletons.skeletonize(cc.label_voxels(frame(spark, a), 20, block=8), 20, chunk=8, least=5).collect()
    assert len(rows) == 20 and sum(r.parent == -1 for r in rows) == 1


def test_direction():
    line = np.array([[0, 0, 0], [1, 1, 0], [2, 2, 0]], float)
    assert np.allclose(reconnect.direction(line), [2**-0.5, 2**-0.5, 0]) and np.allclose(reconnect.direction(line[::-1]), [-(2**-0.5), -(2**-0.5), 0])
    assert not reconnect.direction(line[:1]).any()


def test_trees_on_a_small_tree(spark):
    n = spark.createDataFrame([(1, -1), (2, 1), (3, 2), (4, 2), (5, 4), (9, 77)], "id int, parent int").withColumn("t", F.lit(0))
    assert {r.id: r.size for r in trees.subtree_sizes(n).collect()} == {1: 5, 2: 4, 3: 1, 4: 2, 5: 1, 9: 1}
    assert {r.id for r in trees.roots(n).collect()} == {1, 9}
    assert {r.id: (r.root, r.depth) for r in trees.root_depth(n).collect()}[5] == (1, 3)
    assert {r.id for r in trees.prune_twigs(n, 2).collect()} == {1, 2, 4, 5, 9}
    assert {r.id: r.parent for r in trees.reroot(n, 5).collect()} == {5: -1, 4: 5, 2: 4, 1: 2, 3: 2, 9: 77}


def test_erosion_and_ring(spark):
    a = np.zeros((7, 7, 7), int)
    a[1:6, 1:6, 1:6] = 1
    b = frame(spark, a).withColumnRenamed("v", "label")
    assert morphology.erode(b, 7).count() == 27 and morphology.erode(b, 7, steps=2).count() == 1
    assert morphology.ring(morphology.erode(b, 7, steps=2), 1, 7).count() == 6


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.swc").write_text("# note\n1 0 1.4 2 3 0.5 -1\n2.0 0 4 5 6 1 1 extra\nbad line\n")
    got = files.read_swc(spark, str(tmp_path / "a.swc")).orderBy("id").collect()
    assert [(r.id, r.x, r.parent) for r in got] == [(1, 1.4, -1), (2, 4.0, 1)]
    nodes = spark.createDataFrame([(7, 1, 0, 1.0, 2.0, 3.0, 0.25, -1), (7, 2, 0, 2.0, 2.0, 3.0, 1.0, 1), (8, 1, 0, 0.0, 0.0, 0.0, 1.0, -1)], "t int, " + files.SWC)
    tars = files.tar_bytes(nodes.repartition(1), "t").collect()
    for k, r in enumerate(tars):
        (tmp_path / f"{k}.tar.gz").write_bytes(bytes(r.content))
    back = files.read_tar(spark, str(tmp_path / "*.tar.gz"))
    assert sorted((r.member, r.id, r.radius) for r in back.collect()) == [("7.swc", 1, 0.25), ("7.swc", 2, 1.0), ("8.swc", 1, 1.0)]
    a = np.zeros((2, 3, 4), np.uint8)
    a[1, 2, 3] = 9
    (tmp_path / "v.npy.gz").write_bytes(files.npy_gz(a))
    assert [(r.x, r.y, r.z, r.v) for r in files.read_npy_gz(spark, str(tmp_path / "v.npy.gz")).collect()] == [(1, 2, 3, 9.0)]
    (tmp_path / "p.csv").write_text("x,y,z,id\n1,2,3,5\n4,5,6,7\n")
    assert sorted((r.id, r.x) for r in files.read_points(spark, str(tmp_path / "p.csv"), scale=(2, 1, 1), id_column=3).collect()) == [(5, 2.0), (7, 8.0)]
    (tmp_path / "s.json").write_text('[{"filename": "a.tif", "bounding_box": [[0, 0, 0], [4, 5, 6]]}]')
    assert files.read_spec(spark, str(tmp_path / "s.json")).first().hi_z == 6


def test_stream_keeps_the_maximum(spark, tmp_path):
    from voxstrata.streaming import blocks

    a = np.zeros((4, 4, 4), int)
    a[1, 1, 1] = 3
    frame(spark, a).write.parquet(str(tmp_path / "in/1"))
    frame(spark, a * 2).write.parquet(str(tmp_path / "in/2"))
    q = blocks.upsert_max(blocks.read_voxels(spark, str(tmp_path / "in/*"), 1), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert [(r.x, r.v) for r in blocks.current(spark, str(tmp_path / "out")).collect()] == [(1, 6)]


@pytest.mark.parametrize("version,codec,separator", [(2, None, "."), (2, "zlib", "/"), (3, "gzip", "/"), (3, "zstd", "."), (chunked.N5, None, "."), (chunked.N5, "gzip", ".")])
def test_chunked_arrays(spark, tmp_path, version, codec, separator):
    a = np.random.default_rng(version).integers(0, 4, (11, 9, 7)).astype(np.int16)
    a[:4, :4, :4] = 0  # a chunk that isn't written
    array = chunked.Array(f"file://{tmp_path}/a", version, a.shape, (4, 4, 4), ">i2" if version == chunked.N5 else "<i2", codec, separator=separator)
    assert sum(r.n for r in chunked.write_array(frame(spark, a), array).collect()) == (a != 0).sum()
    assert chunked.open_array(array.path) == array
    assert (dense(chunked.read_array(spark, array.path), a.shape) == a).all()
    box = chunked.read_array(spark, array.path, lo=(2, 3, 1), hi=(9, 99, 6))
    want = np.zeros_like(a)
    want[2:9, 3:, 1:6] = a[2:9, 3:, 1:6]
    assert (dense(box, a.shape) == want).all()
    assert chunked.read_array(spark, array.path, lo=(20, 0, 0)).count() == 0


def test_written_arrays_hold_zeros_where_nothing_is(spark, tmp_path):
    one = spark.createDataFrame([(1, 1, 2, 5)], "x int, y int, z int, v long")
    array = chunked.Array(f"file://{tmp_path}/a", 2, (4, 4, 6), (4, 4, 2), "<i8", fill=7)
    assert sum(r.n for r in chunked.write_array(one, array).collect()) == 1
    assert [tuple(r) for r in chunked.read_array(spark, array.path).collect()] == [(1, 1, 2, 5)]
    other = spark.createDataFrame([(3, 3, 5, 2**60 + 1)], "x int, y int, z int, v long")
    with pytest.raises(FileExistsError):
        chunked.write_array(other, array)
    chunked.write_array(other, array, overwrite=True).count()
    assert [tuple(r) for r in chunked.read_array(spark, array.path).collect()] == [(3, 3, 5, 2**60 + 1)]


def test_n5_blocks_cut_at_an_end(spark, tmp_path):
    """As other software writes them: axes in reverse, big endian, the last block only as large as the extent."""
    (tmp_path / "1" / "0").mkdir(parents=True)
    (tmp_path / "attributes.json").write_text(json.dumps({"dimensions": [3, 2, 2], "blockSize": [2, 2, 2], "dataType": "uint16", "compression": {"type": "raw"}}))
    cube = np.array([[[258], [2]], [[3], [4]]], ">u2")  # x, y, z of one section
    (tmp_path / "1" / "0" / "0").write_bytes(bytes([0, 0, 0, 3, 0, 0, 0, 1, 0, 0, 0, 2, 0, 0, 0, 2]) + cube.tobytes())
    got = {(r.x, r.y, r.z): r.v for r in chunked.read_array(spark, f"file://{tmp_path}").collect()}
    assert got == {(0, 0, 2): 258, (0, 1, 2): 2, (1, 0, 2): 3, (1, 1, 2): 4}


def test_precomputed_scales(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 250, (13, 10, 9))
    path = f"file://{tmp_path}/p"
    n = chunked.write_precomputed(frame(spark, a), path, a.shape, (4, 4, 4), resolution=(2, 2, 5), scales=3).count()
    assert n == 4 * 3 * 3 + 2 * 2 * 1 + 1
    info = json.loads((tmp_path / "p" / "info").read_text())
    assert [s["key"] for s in info["scales"]] == ["2_2_5", "4_4_10", "8_8_20"] and info["scales"][1]["size"] == [6, 5, 4]
    assert (tmp_path / "p" / "2_2_5" / "12-13_8-10_8-9").read_bytes() == a[12:13, 8:10, 8:9].astype(np.uint8).tobytes(order="F")
    want = a
    for scale in range(3):
        assert (dense(chunked.read_precomputed(spark, path, scale), want.shape) == want).all()
        x, y, z = (2 * (s // 2) for s in want.shape)
        want = want[:x, :y, :z].reshape(x // 2, 2, y // 2, 2, z // 2, 2).sum((1, 3, 5)) // 8
    with pytest.raises(FileExistsError):
        chunked.write_precomputed(frame(spark, a), path, a.shape)


def test_chunked_array_of_five_axes(spark, tmp_path):
    """As other software writes it: t, c, x, y, z, big endian, Fortran order, a fill value."""
    cube = np.arange(8, dtype=">u2").reshape(2, 2, 2)
    (tmp_path / "0" / "1" / "0" / "0").mkdir(parents=True)
    meta = {"zarr_format": 2, "shape": [1, 2, 3, 2, 2], "chunks": [1, 1, 2, 2, 2], "dtype": ">u2", "compressor": None, "fill_value": 9, "order": "F", "filters": None, "dimension_separator": "/"}
    (tmp_path / ".zarray").write_text(json.dumps(meta))
    (tmp_path / "0" / "1" / "0" / "0" / "0").write_bytes(cube.reshape(1, 1, 2, 2, 2).tobytes(order="F"))
    got = {(r.x, r.y, r.z): r.v for r in chunked.read_array(spark, f"file://{tmp_path}", at=(0, 1)).collect()}
    want = {(int(i), int(j), int(k)): int(cube[i, j, k]) for i, j, k in np.ndindex(2, 2, 2) if cube[i, j, k]} | {(2, j, k): 9 for j in (0, 1) for k in (0, 1)}
    assert got == want
    meta["compressor"] = {"id": "blosc"}
    (tmp_path / ".zarray").write_text(json.dumps(meta))
    with pytest.raises(ValueError):
        chunked.open_array(f"file://{tmp_path}")


def test_cycles_of_parents_are_no_trees(spark):
    n = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, -1), (5, 4)], "id int, parent int")
    with pytest.raises(ValueError):
        trees.root_depth(n)
    with pytest.raises(ValueError):
        trees.subtree_sizes(n)


def test_store_counts_logged_writes_only(spark, tmp_path):
    nodes = spark.createDataFrame([(k, 10 * t + i, 10 * t + i - 1 if i else -1, t, i, i, i, 1) for k, (t, i) in enumerate((t, i) for t in range(4) for i in range(5))], "k int, id int, parent int, tree int, x int, y int, z int, radius int")
    s = store.SkeletonStore(spark, f"file://{tmp_path}/s", shard=2)
    packed = store.pack(nodes, "tree")
    s.write(packed)
    assert [len(r.edges) for r in s.read().collect()] == [4] * 4 and s.read().inputFiles().__len__() >= 2
    s._put(packed, "w-lost")  # a write that failed before it was logged
    s._drop(packed.select("segid"), "w-lost")
    assert s.read().count() == 4
    s.overwrite(packed.where("segid = 1").withColumn("n_vertices", F.lit(7)))
    assert sorted((r.segid, r.n_vertices) for r in s.read().collect()) == [(0, 5), (1, 7), (2, 5), (3, 5)]
    s.delete(packed.where("segid = 1").select("segid"))
    assert s.read().count() == 3


def test_radii_from_the_tree(spark):
    n = spark.createDataFrame([(1, -1, 0, None), (2, 1, 0, 5.0), (3, 2, 0, None), (4, 3, 0, None), (5, 4, 0, 9.0), (6, 1, 0, None), (7, -1, 1, None)], "id int, parent int, tree int, r double")
    got = {r.id: r.value for r in samples.filled_from_tree(n, "tree", "r", 0.1).collect()}
    assert got == {1: 5.0, 2: 5.0, 3: 5.0, 4: 9.0, 5: 9.0, 6: 7.0, 7: 0.1}


def test_knn_over_clusters(spark):
    """Half of the points lie in one small cluster, some hundreds at one place."""
    rng = np.random.default_rng(9)
    pts = [(k, 500, 500, 500) for k in range(0, 900, 3)] + [(k, *map(int, rng.integers(495, 506, 3))) for k in range(1, 900, 3)] + [(k, *map(int, rng.integers(0, 1000, 3))) for k in range(2, 900, 3)]
    queries = [(k, *map(int, rng.integers(480, 520, 3))) for k in range(40)] + [(k, *map(int, rng.integers(0, 1000, 3))) for k in range(40, 60)] + [(60, 500, 500, 500)]
    p, q = (spark.createDataFrame(rows, "id int, x int, y int, z int") for rows in (pts, queries))
    place = np.array([r[1:] for r in pts])
    for k, same in ((1, False), (3, True)):
        got = {}
        for r in spatial.knn(q, p, k, same=same).collect():
            got.setdefault(r.id, {})[r["rank"]] = (r.d2, r.nn)
        for i, *at in queries:
            d2 = ((place - at) ** 2).sum(1)
            want = sorted((int(d), n[0]) for d, n in zip(d2, pts) if not (same and n[0] == i))[:k]
            assert [got[i][n + 1] for n in range(k)] == want
