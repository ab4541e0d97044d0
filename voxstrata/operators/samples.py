"""Training-side operators: block rejection, locations, intensity changes, losses, point partners, stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxstrata.functions.boxes import AXES, ball, cell, closed, shifted
from voxstrata.functions.ranked import best_of
from voxstrata.functions.shared import materialised
from voxstrata.operators.morphology import inside
from voxstrata.operators.trees import jumps, nearest_above
from voxstrata.operators.voxel import densify, section_means


def accepted_blocks(mask: DataFrame, block: int, least: float, keep: float = 0.0, seed: int = 0) -> DataFrame:
    """bx, by, bz, share of blocks whose share of masked places is over least; others stay with probability keep, drawn by seed."""
    got = mask.where("v > 0").groupBy(*[cell(a, block).alias(f"b{a}") for a in AXES]).agg((F.count("*") / F.lit(float(block**3))).alias("share"))
    draw = (F.pmod(F.xxhash64("bx", "by", "bz", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < keep
    return got.where((F.col("share") > least) | draw)


def location_boxes(centres: DataFrame, size: int, voxel: int, lo, hi) -> DataFrame:
    """id, x0 .. z1: boxes around centres, moved to the voxel grid; those not within lo..hi are skipped."""
    for a in AXES:
        start = F.bround((F.col(a) - size / 2) / voxel) * voxel
        centres = centres.withColumns({f"{a}0": start.cast("int"), f"{a}1": (start + size).cast("int")})
    fits = F.lit(True)
    for a, low, high in zip(AXES, lo, hi):
        fits = fits & (F.col(f"{a}0") >= low) & (F.col(f"{a}1") <= high)
    return centres.where(fits).select("id", *[f"{a}{e}" for a in AXES for e in (0, 1)])


def point_weights(points: DataFrame, near: DataFrame) -> DataFrame:
    """id, w: 1 over the number of points within the balance radius, the point itself included.  near: id1, id2 pairs."""
    n = near.select(F.explode(F.array("id1", "id2")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return points.select("id").join(n, "id", "left").select("id", (1 / (1 + F.coalesce("n", F.lit(0)))).alias("w"))


def intensity(df: DataFrame, scale: float, shift: float, low: float, high: float, lo, hi, section: str | None = "z") -> DataFrame:
    """mean + (v - mean) * scale + shift, clipped, at every place of the box, zeros as well; the mean is of each section, or of all."""
    dense = densify(df, lo, hi)
    if section:
        joined = dense.join(section_means(df, lo, hi, section), section, "left")
    else:
        places = float((hi[0] - lo[0]) * (hi[1] - lo[1]) * (hi[2] - lo[2]))
        joined = dense.crossJoin(F.broadcast(df.agg((F.sum("v") / F.lit(places)).alias("m"))))  # one row
    m = F.coalesce("m", F.lit(0.0))
    v = m + (F.col("v") - m) * scale + shift
    return joined.select(*AXES, F.least(F.greatest(v, F.lit(low)), F.lit(high)).alias("v"))


def noise(df: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Gaussian noise that depends on the place and the seed only, by Box and Muller from two hashes."""
    u = lambda k: (F.pmod(F.xxhash64(*AXES, F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    return df.withColumn("v", F.col("v") + sigma * F.sqrt(-2 * F.log(u(0))) * F.cos(2 * F.pi() * u(1)))


def binary_cross_entropy(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """loss: mean of the losses of p against y, weighted if a weight column is named."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-7)), F.lit(1 - 1e-7))
    one = -(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.agg((F.sum(one * w) / F.sum(w)).alias("loss"))


def partner_kinds(points: DataFrame, partners: DataFrame) -> DataFrame:
    """id, kind, partner: pre or post by the partners' column (pre, post) that a point is in; the smallest partner."""
    sides = F.array(F.struct(F.col("pre").alias("id"), F.lit(0).alias("post"), F.col("post").alias("partner")), F.struct(F.col("post").alias("id"), F.lit(1).alias("post"), F.col("pre").alias("partner")))
    both = partners.select(F.explode(sides).alias("s")).select("s.*").groupBy("id").agg(F.max("post").alias("post"), F.min("partner").alias("partner"))
    return points.select("id").join(both, "id", "left").select("id", F.when(F.col("post") == 1, "post").when(F.col("post") == 0, "pre").alias("kind"), "partner")


def stamps(points: DataFrame, mask: DataFrame, radius: float, side: int) -> DataFrame:
    """x, y, z, id: balls around points, only where the mask has the label that it has at the point; the smallest id wins."""
    here = points.join(mask.select(*AXES, F.col("v").alias("label")), list(AXES)).select("id", "label", *AXES)
    spread = shifted(here, ball(radius)).where(inside(side))
    return spread.join(mask.select(*AXES, F.col("v").alias("label")), [*AXES, "label"]).groupBy(*AXES).agg(F.min("id").alias("id"))


def affine(points: DataFrame, m) -> DataFrame:
    """Places times a 3 x 3 matrix."""
    rest = [c for c in points.columns if c not in AXES]
    return points.select(*rest, *[sum([F.col(b) * float(m[i][j]) for j, b in enumerate(AXES)], F.lit(0.0)).alias(a) for i, a in enumerate(AXES)])


def remove_and_move(nodes: DataFrame, tree: str, lo, hi, move) -> DataFrame:
    """Nodes outside the closed box, moved; children of dropped nodes become roots, trees of one node or none go."""
    gone = nodes.where(closed(lo, hi)).select(F.col("id").alias("parent"), F.lit(True).alias("gone"))
    kept = nodes.where(~closed(lo, hi)).join(gone, "parent", "left").withColumn("parent", F.when(F.col("gone"), F.lit(-1)).otherwise(F.col("parent")).cast("int")).drop("gone")
    big = kept.groupBy(tree).agg(F.count("*").alias("n")).where("n > 1").select(tree)
    return kept.join(big, tree, "left_semi").withColumns({a: (F.col(a) + m).cast("int") for a, m in zip(AXES, move)})


def surface_fuse(tile: DataFrame, surface: DataFrame, axis: str = "z") -> DataFrame:
    """Columns of voxels moved along an axis by a surface map over the two others, shifted to be at least zero."""
    others = [a for a in AXES if a != axis]
    low = surface.agg(F.min("s").alias("low"))
    s = surface.crossJoin(F.broadcast(low)).select(*others, (F.col("s") - F.col("low")).alias("s"))  # one row
    return tile.join(s, others).withColumn(axis, (F.col(axis) + F.col("s")).cast("int")).select(*AXES, "v")


def filled_from_tree(nodes: DataFrame, tree: str, column: str, default: float) -> DataFrame:
    """id, value: the column where it's set, else that of the nearest node up or down the tree that has it set, by steps.

    Up goes before down at equal steps, the smaller id among the nodes below; without any, the tree's mean, without that the default."""
    up = nearest_above(nodes, F.col(column).isNotNull()).select("id", F.col("at").alias("above"), "steps")
    below = materialised(nodes.select("id", F.when(F.col(column).isNotNull(), F.struct(F.lit(0).alias("steps"), F.col("id").alias("node"), F.col(column).alias("value"))).alias("b")), "below")
    step = 1
    for jump in jumps(nodes):
        deeper = jump.where("up <> -1").join(below.where("b is not null"), "id").groupBy(F.col("up").alias("id")).agg(F.min(F.struct((F.col("b.steps") + step).alias("steps"), F.col("b.node").alias("node"), F.col("b.value").alias("value"))).alias("d"))
        below = materialised(below.join(deeper, "id", "left").select("id", F.least("b", "d").alias("b")), "below")
        step *= 2
    set_here = nodes.select(F.col("id").alias("above"), F.col(column).alias("above_value"))
    mean = materialised(nodes.groupBy(tree).agg(F.avg(column).alias("mean")), "means")
    near = nodes.select("id", tree, column).join(up, "id").join(set_here, "above", "left").join(below, "id").join(mean, tree)
    above = F.when(F.col("b").isNull() | (F.col("steps") <= F.col("b.steps")), F.col("above_value"))
    return near.select("id", F.coalesce(column, above, "b.value", "above_value", "mean", F.lit(default)).alias("value"))


def banded_pairs(pairs: DataFrame, band: int) -> DataFrame:
    """The best-scored pair of each left point within its nearest band of distances that has any; ties to the smaller id."""
    banded = best_of(pairs.withColumn("band", F.ceil(F.sqrt("d2") / band)), ["id1", "band"], "score", "id2")
    w = Window.partitionBy("id1").orderBy("band")
    return banded.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "band")


def malis_passes(labels: DataFrame, ignore: DataFrame) -> DataFrame:
    """pass, x, y, z, label: in pass 0 ignored places get a label of their own, above all others; pass 1 has the labels."""
    top = labels.agg((F.max("v") + 1).alias("top"))
    negative = labels.join(ignore.select(*AXES, F.lit(True).alias("ig")), list(AXES), "left").crossJoin(F.broadcast(top)).select(F.lit(0).alias("pass"), *AXES, F.when(F.col("ig"), F.col("top")).otherwise(F.col("v")).alias("label"))
    return negative.unionByName(labels.select(F.lit(1).alias("pass"), *AXES, F.col("v").alias("label")))
