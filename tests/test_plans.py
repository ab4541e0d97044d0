"""Plans: filters and columns reach the files, and no data is joined without a key."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.operators import blend, model, store
from voxstrata.plans import commands, registry
from voxstrata.sources.tables import swc_nodes, voxels

SF = "/root/testdata/sf0.001"
#: Queries whose keyless joins have a side of one row, or of a number of rows that is a parameter.
CONSTANT_SIDES = {"h_cc_remove_small", "g_weights_zung", "g_weights_wu", "g_mask_edge", "g_segment_accumulate", "f_surface_fuse", "c_malis_passes", "g_equalize_command", "g_segment_command", "i_skeletonize_command", "g_relabel_command"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - CONSTANT_SIDES))
def test_no_keyless_joins(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_the_columns_they_need(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    text = plan(voxels(spark, SF))
    assert "l_comment" not in text and "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_extendedprice:double>" in text


def test_box_queries_reach_the_store(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    s = store.SkeletonStore(spark, f"file://{tmp_path}/store")
    s.write(store.pack(swc_nodes(spark, SF), "tree_id"))
    s.delete(spark.range(3).select(F.col("id").alias("segid")))
    q = s.by_box((0, 0, 0), (5, 5, 5)).select("segid")
    assert "LessThanOrEqual(min_x" in plan(q) and "vertices" not in plan(q).split("ReadSchema")[1]
    assert s.by_id(spark.range(6).select(F.col("id").alias("segid"))).count() == 3
    assert s.manifest().agg(F.sum("n")).first()[0] == s.read().count()


def test_writers_of_one_number_leave_one_row(spark, tmp_path):
    s = store.SkeletonStore(spark, f"file://{tmp_path}/store")
    packed = store.pack(swc_nodes(spark, SF), "tree_id")
    s.write(packed)
    one = packed.where("segid = 3")
    for name in ("w-a", "w-b"):  # both took 2, neither saw the other
        s._put(one, name)
        s._drop(one.select("segid"), name)
    spark.createDataFrame([("w-a", 2), ("w-b", 2)], "write string, seq long").write.mode("append").parquet(f"{s.path}/log")
    rows = s.by_id(spark.createDataFrame([(3,)], "segid long")).collect()
    assert len(rows) == 1 and rows[0].seq == 2 and "write" not in s.read().columns and s.read().count() == packed.count()


def test_segment_runs_the_model_in_every_window(spark):
    """Against numpy: contrast, model and sigmoid in each window by itself, the outputs accumulated in the windows' order."""
    side, size = 12, 8
    a = np.where(np.random.default_rng(1).random((side,) * 3) < 0.4, np.random.default_rng(2).integers(1, 250, (side,) * 3), 0)
    a[8:] = 0
    rows = [(int(x), int(y), int(z), int(a[x, y, z])) for x, y, z in np.argwhere(a)]
    got = np.zeros(a.shape, int)
    for r in commands.segment(spark.createDataFrame(rows, "x int, y int, z int, v int"), side, size).collect():
        got[r.x, r.y, r.z] = r.v
    weights = np.zeros((size,) * 3)
    for r in blend.weights(spark, size, size // 2).collect():
        weights[r.dx, r.dy, r.dz] = r.w
    want = np.zeros(a.shape)
    for at in itertools.product((0, 4), repeat=3):
        w = tuple(slice(k, k + size) for k in at)
        if not a[w].any():
            continue
        low, high = np.percentile(a[w], [5, 99.5])
        share = np.clip((a[w] - low) * (1 / (high - low) if high > low else 1.0), 0, 1)
        p = 1 / (1 + np.exp(-(model.box_filter(np.floor(share * 255)) - 2000) / 500))
        want[w] = np.minimum(np.floor(want[w] + np.floor(p * 255) * weights), 254)
    assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.999 and want.max() > 50
