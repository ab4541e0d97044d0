"""Blending and fusing of overlapping tiles, and aggregates over voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES


def place(tile: DataFrame, move, ordinal: int) -> DataFrame:
    """A tile's voxels at its translation, with the tile's ordinal."""
    return tile.select(*[(F.col(a) + m).cast("int").alias(a) for a, m in zip(AXES, move)], "v", F.lit(ordinal).alias("tile"))


def blend_max(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy(*AXES).agg(F.max("v").alias("v"))


def blend_last(tiles: DataFrame) -> DataFrame:
    """The tile of the largest ordinal that has the voxel wins."""
    return tiles.groupBy(*AXES).agg(F.max_by("v", "tile").alias("v"))


def blend_weighted(tiles: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean of the tiles that have the voxel."""
    return tiles.withColumn("w", weight).groupBy(*AXES).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def accumulate(windows: DataFrame, weights: DataFrame, block: int, cap: int = 254) -> DataFrame:
    """x, y, z, v: each window's int(255 p) times its weight, added in window order with truncation at each step and a cap.

    windows: wx, wy, wz (low corner), x, y, z, p; weights: dx, dy, dz, w.  At most 27 windows hold a voxel, so a voxel's list is bounded."""
    at = windows.withColumns({f"d{a}": F.col(a) - F.col(f"w{a}") for a in AXES})
    parts = at.join(F.broadcast(weights), [f"d{a}" for a in AXES])  # block ** 3 rows, whatever the volume
    step = F.struct("wx", "wy", "wz", (F.floor(F.col("p") * 255) * F.col("w")).alias("a"))
    folded = F.aggregate(F.array_sort(F.collect_list(step)), F.lit(0.0), lambda s, t: F.least(F.floor(s + t["a"]).cast("double"), F.lit(float(cap))))
    return parts.groupBy(*AXES).agg(folded.cast("int").alias("v"))


def bump_logit(u: Column, t: float = 1.5) -> Column:
    return -F.pow(u * (1 - u), F.lit(-t))


def weights(spark: SparkSession, size: int, overlap: int, kind: str = "zung") -> DataFrame:
    """dx, dy, dz, w of a cube's places: its bump over the sum of the bumps of the 27 cubes of a grid with that overlap.

    Kinds: zung (exponent of a logit against the largest logit there), wu, wu_no_crust (its outer faces zero).  A bump is a
    product over the axes only for wu; for zung the largest logit couples them, so the cubes are exploded."""
    stride = size - overlap
    d = spark.range(size).select(F.col("id").cast("int").alias("d"))
    u = (F.col("c") + 1.0) / (size + 1.0)
    axis = d.crossJoin(spark.range(-1, 2).select(F.col("id").cast("int").alias("o"))).select("d", "o", (F.col("d") - F.col("o") * stride).alias("c")).where((F.col("c") >= 0) & (F.col("c") < size))  # 3 * size rows
    if kind == "zung":
        part = bump_logit(u)
    else:
        s = u * 2.0 - 1.0
        part = -1.0 / (1.0 - s * s)
    axis = axis.withColumn("l", part).withColumn("crust", (F.col("c") == 0) | (F.col("c") == size - 1))
    cols = lambda n: axis.select(F.col("d").alias(f"d{n}"), F.col("o").alias(f"o{n}"), F.col("l").alias(f"l{n}"), F.col("crust").alias(f"k{n}"))
    cubes = cols("x").crossJoin(cols("y")).crossJoin(cols("z"))  # (3 * size) ** 3 rows, a constant of the operator
    logit = F.col("lx") + F.col("ly") + F.col("lz")
    own = (F.col("ox") == 0) & (F.col("oy") == 0) & (F.col("oz") == 0)
    keys = ["dx", "dy", "dz"]
    if kind == "zung":
        top = cubes.groupBy(*keys).agg(F.max(logit).alias("m"))
        bumps = cubes.join(top, keys).withColumn("b", F.exp(logit - F.col("m")))
    else:
        crust = F.col("kx") | F.col("ky") | F.col("kz")
        bumps = cubes.withColumn("b", F.when(crust & F.lit(kind == "wu_no_crust"), F.lit(0.0)).otherwise(F.exp(logit)))
    return bumps.groupBy(*keys).agg((F.sum(F.when(own, F.col("b")).otherwise(0.0)) / F.sum("b")).alias("w"))


def mask_edge(weights: DataFrame, size: int, edge) -> DataFrame:
    """Weights (dx, dy, dz, w) of a cube with so many outer layers of each axis zero: at its low end, or its high end for a negative number."""
    gone = F.lit(False)
    for a, e in zip(AXES, edge):
        if abs(e) >= size:
            raise ValueError("nothing would be left")
        if e:
            gone = gone | ((F.col(f"d{a}") < e) if e > 0 else (F.col(f"d{a}") >= size + e))
    return weights.withColumn("w", F.when(gone, F.lit(0.0)).otherwise(F.col("w")))


def extent(tiles: DataFrame) -> DataFrame:
    """Low corner and shape of tiles (ox .. oz, nx .. nz) that lie at translations."""
    return tiles.agg(*[F.min(f"o{a}").alias(f"lo_{a}") for a in AXES], *[(F.max(F.col(f"o{a}") + F.col(f"n{a}")) - F.min(f"o{a}")).alias(f"n_{a}") for a in AXES])


def label_balance(classed: DataFrame, slab: str, classes: int, places: int, clip_min: float = 0.05, clip_max: float = 0.95) -> DataFrame:
    """slab, label, w: 1 / (classes * clipped share) of each label in a slab of so many places; those without a row have label 0."""
    held = classed.groupBy(slab, "label").agg(F.count("*").alias("n"))
    empty = held.groupBy(slab).agg((F.lit(places) - F.sum("n")).alias("n")).select(slab, F.lit(0).cast(held.schema["label"].dataType).alias("label"), "n").where("n > 0")
    counts = held.unionByName(empty).groupBy(slab, "label").agg(F.sum("n").alias("n"))
    total = counts.groupBy(slab).agg(F.sum("n").alias("t"))
    share = F.least(F.greatest(F.col("n") / F.col("t"), F.lit(clip_min)), F.lit(clip_max))
    return counts.join(total, slab).select(slab, "label", (1 / (classes * share)).alias("w"))


def iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """inter, union, iou of two foregrounds' places: one pass over their union, one aggregate."""
    both = a.select(*AXES, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*AXES, F.lit(0).alias("a"), F.lit(1).alias("b"))).groupBy(*AXES).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.sum(F.col("a") * F.col("b")).alias("inter"), F.count("*").alias("union")).withColumn("iou", F.col("inter") / F.col("union"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Per node and method: count, min, max, mean, median of durations and the span from first start to last stop."""
    d = F.col("stop") - F.col("start")
    return timings.groupBy("node", "method").agg(F.count("*").alias("n"), F.min(d).alias("min"), F.max(d).alias("max"), F.avg(d).alias("mean"), F.percentile(d, F.lit(0.5)).alias("median"), (F.max("stop") - F.min("start")).alias("span"))
