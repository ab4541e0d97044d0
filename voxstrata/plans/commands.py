"""The user-visible commands, composed of operators: equalize, segment, fuse, relabel, skeletonize, reconnect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES
from voxstrata.operators import blend, cc, model, reconnect, skeletons, spatial, trees, voxel


def _windows(df: DataFrame, side: int, size: int) -> DataFrame:
    """Every window of half overlap that holds a voxel, as wx, wy, wz; at most eight a voxel."""
    step, last = size // 2, (side - size) // (size // 2)
    for a in AXES:
        low = F.greatest(F.floor((F.col(a) - step) / step), F.lit(0))
        high = F.least(F.floor(F.col(a) / step), F.lit(last))
        df = df.withColumn(f"w{a}", F.explode(F.sequence(low, high))).withColumn(f"w{a}", (F.col(f"w{a}") * step).cast("int"))
    return df


def _stretched(w: DataFrame, size: int, low: float, high: float) -> DataFrame:
    """Rows of windows with share, the value stretched between the window's percentiles to 0..1; a window's missing places are zeros."""
    keys = ["wx", "wy", "wz"]
    counted = w.groupBy(*keys, F.col("v").cast("double").alias("v")).agg(F.count("*").alias("n"))
    zeros = w.groupBy(*keys).agg((F.lit(size**3) - F.count("*")).alias("n")).where("n > 0").select(*keys, F.lit(0.0).alias("v"), "n")
    stats = counted.unionByName(zeros).groupBy(*keys).agg(F.percentile("v", F.array(F.lit(low), F.lit(high)), F.col("n")).alias("p"))
    p1, p2 = F.col("p")[0], F.col("p")[1]
    share = F.least(F.greatest((F.col("v") - p1) * F.when(p2 > p1, 1 / (p2 - p1)).otherwise(1.0), F.lit(0.0)), F.lit(1.0))
    return w.join(stats, keys).withColumn("share", share)


def equalize(voxels: DataFrame, side: int, size: int, low: float, high: float) -> DataFrame:
    """Percentile stretch in windows of half overlap, blended by the windows' bumps."""
    placed = _stretched(_windows(voxels, side, size), size, low, high).withColumns({f"d{a}": F.col(a) - F.col(f"w{a}") for a in AXES})
    weighed = placed.join(F.broadcast(blend.weights(voxels.sparkSession, size, size // 2)), [f"d{a}" for a in AXES])  # size ** 3 rows
    return weighed.groupBy(*AXES).agg(F.floor(F.sum(F.col("share") * 255 * F.col("w")) / F.sum("w") + 1e-9).cast("int").alias("v"))


def segment(voxels: DataFrame, side: int, size: int, forward: model.Model = model.box_filter, low: float = 0.05, high: float = 0.995, centre: float = 2000, scale: float = 500) -> DataFrame:
    """Each window of half overlap with a voxel: contrast, model, sigmoid; the windows' outputs accumulated with their weights."""
    w = _stretched(_windows(voxels, side, size), size, low, high).withColumn("v", F.floor(F.col("share") * 255).cast("int"))
    p = model.apply_windows(w, forward, size).withColumn("p", voxel.sigmoid((F.col("p") - centre) / scale))
    return blend.accumulate(p, blend.weights(voxels.sparkSession, size, size // 2), size)


def fuse(tiles: list[tuple[DataFrame, tuple[int, int, int]]], mode: str = "overwrite") -> DataFrame:
    """Tiles at their translations: max of all, or the last tile that has data there."""
    placed = reduce(DataFrame.unionByName, [blend.place(t, move, k) for k, (t, move) in enumerate(tiles)])
    return blend.blend_max(placed) if mode == "max" else blend.blend_last(placed)


def relabel(voxels: DataFrame, points: DataFrame, side: int, threshold: float = 15, least: int = 10, block: int = 16) -> DataFrame:
    """Components of at least `least` voxels that a skeleton point lies in get the id of the nearest point."""
    labelled = cc.remove_small(cc.label_voxels(voxel.threshold(voxels, threshold), side, block=block), least)
    return spatial.relabel_nearest(labelled, points)


def skeletonize(voxels: DataFrame, side: int, threshold: float, least: int, dust: int, block: int = 16, chunk: int = 64) -> DataFrame:
    """label, id, parent, x, y, z of the skeletons with more than `dust` nodes, drawn chunk by chunk."""
    labelled = cc.remove_small(cc.label_voxels(voxel.threshold(voxels, threshold), side, block=block), least)
    rows = skeletons.skeletonize(labelled, side, chunk, least)
    big = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > dust).select("label")
    return rows.join(big, "label", "left_semi")


def reconnect_fragments(nodes: DataFrame, tree: str, radius: int, weights: dict[str, tuple[float, float, float]], bias: float, thresh: float, find_min_collin: float, merge_min_collin: float = 0.5, least: int = 2) -> DataFrame:
    """component, members, n_pairs: split at branches, pair ends, score, and merge.  weights: feature -> (mean, scale, weight)."""
    parts = nodes.select("id", *AXES).join(trees.split_branches(nodes, tree, least), "id")
    pairs = reconnect.find_pairs(parts.withColumnRenamed("root", "part"), "part", radius)
    pairs = pairs.where(F.least(*[c for c in pairs.columns if c.startswith("c_")]) >= find_min_collin)
    names = list(weights)
    scored = reconnect.probability(pairs, names, [weights[n][0] for n in names], [weights[n][1] for n in names], [weights[n][2] for n in names], bias)
    return reconnect.merge_pairs(scored, parts.select("id", F.col("root").alias("tree")), thresh, merge_min_collin)
