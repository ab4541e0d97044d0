"""Changes of intensities and places for training, over the dense places of a half-open box lo..hi.

What the draws of an augmentation would give (amounts, places, levels) are parameters, so
that a result depends on its input alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES
from voxstrata.operators.voxel import densify, shift_sections


def brightness(df: DataFrame, shift: float, lo, hi) -> DataFrame:
    """Every place moved by a shift."""
    return densify(df, lo, hi).select(*AXES, (F.col("v") + F.lit(shift)).alias("v"))


def reflected(c: Column, low: int, high: int) -> Column:
    """A coordinate beyond low..high, mirrored at the edges of its outermost voxels."""
    n = high - low
    at = F.pmod(c - low, F.lit(2 * n))
    return (F.lit(low) + F.when(at < n, at).otherwise(2 * n - 1 - at)).cast("int")


def smoothed(df: DataFrame, kernels: dict[str, list[float]], lo, hi) -> DataFrame:
    """x, y, z, v: dense df weighed along each named axis by a kernel of odd length; edges are mirrored.  One pass an axis."""
    out = df.select(*AXES, F.col("v").cast("double").alias("v"))
    for a, kernel in kernels.items():
        low, high, half = lo[AXES.index(a)], hi[AXES.index(a)], len(kernel) // 2
        taps = F.explode(F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel)]))
        # each place asks for the places around it, mirrored; the kernel's length bounds the copies
        asked = out.select(*AXES, taps.alias("t")).select(*AXES, reflected(F.col(a) + F.col("t.o"), low, high).alias("from"), F.col("t.w").alias("w"))
        source = out.select(*[F.col(b).alias("from" if b == a else b) for b in AXES], "v")
        others = [b for b in AXES if b != a]
        out = asked.join(source, [*others, "from"]).groupBy(*AXES).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """A kernel that sums to one."""
    half = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def blur(df: DataFrame, sigma: dict[str, float], lo, hi) -> DataFrame:
    """Gaussian blur, with the fine noise put back: what each place has over the median of the 27 around it."""
    dense = densify(df, lo, hi)
    around = dense.select(*AXES, "v")
    for a, low, high in zip(AXES, lo, hi):
        around = around.withColumn("o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(f"s{a}", reflected(F.col(a) + F.col("o"), low, high)).drop("o")
    source = dense.select(*[F.col(a).alias(f"s{a}") for a in AXES], F.col("v").alias("near"))
    median = around.join(source, ["sx", "sy", "sz"]).groupBy(*AXES).agg(F.first("v").alias("raw"), F.percentile("near", F.lit(0.5)).alias("median"))
    soft = smoothed(dense, {a: gaussian(s) for a, s in sigma.items()}, lo, hi)
    return soft.join(median, list(AXES)).select(*AXES, (F.col("v") + F.col("raw") - F.col("median")).alias("v"))


def duplicate_sections(df: DataFrame, axis: str, at: int, n: int, lo, hi) -> DataFrame:
    """n sections from `at` on become copies of the first of them, each with its own fine noise: what it has over its 27-place mean within the n."""
    k = AXES.index(axis)
    low, high = list(lo), list(hi)
    low[k], high[k] = at, at + n
    dense = densify(df, lo, hi)
    slab = dense.where((F.col(axis) >= at) & (F.col(axis) < at + n))
    mean = smoothed(slab, {a: [1 / 3] * 3 for a in AXES}, low, high).withColumnRenamed("v", "mean")
    others = [a for a in AXES if a != axis]
    first = slab.where(F.col(axis) == at).select(*others, F.col("v").alias("first"))
    copies = slab.join(mean, list(AXES)).join(first, others).select(*AXES, (F.col("first") + F.col("v") - F.col("mean")).alias("v"))
    return dense.where((F.col(axis) < at) | (F.col(axis) >= at + n)).select(*AXES, F.col("v").cast("double").alias("v")).unionByName(copies)


def occlude(df: DataFrame, centre, reach, sigma, level: Column | float, lo, hi) -> DataFrame:
    """Places within reach of a centre drawn towards a level, the more the nearer: by a bell of sigma on each axis.  Values are cut to whole numbers."""
    bell, near = F.lit(0.0), F.lit(True)
    for a, c, r, s in zip(AXES, centre, reach, sigma):
        d = F.col(a) - F.lit(c)
        bell, near = bell + d * d / F.lit(2.0 * s * s), near & (d >= -r) & (d < r)
    share = F.when(near, F.exp(-bell)).otherwise(0.0)
    level = F.lit(float(level)) if isinstance(level, (int, float)) else level
    return densify(df, lo, hi).select(*AXES, (F.col("v") * (1 - share) + share * level).cast("int").alias("v"))


def stitch(df: DataFrame, axis: str, at: int, error: int, along: str, lo: int, hi: int) -> DataFrame:
    """A misaligned seam: what lies before `at` on an axis is moved by error along another; the box lo..hi of that one ends earlier by error."""
    shifts = df.select(axis).distinct().select(axis, F.when(F.col(axis) < at, -error).otherwise(0).alias("shift"))
    return shift_sections(df, shifts, along, lo, hi - error, axis)


def stack(batches: list[DataFrame]) -> DataFrame:
    """n, x, y, z, v: batches side by side, by number."""
    out = None
    for n, b in enumerate(batches):
        one = b.select(F.lit(n).alias("n"), *AXES, "v")
        out = one if out is None else out.unionByName(one)
    return out
