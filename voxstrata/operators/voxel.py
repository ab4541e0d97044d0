"""Voxel-wise projections, filters and block statistics over sparse voxels (x, y, z, v).

A missing voxel is zero: operators whose result depends on zeros (percentiles,
means, padding) count them from the extent instead of storing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES, cell

SCALE = {"uint8": 1 / 255, "uint16": 1 / 65535, "float32": 1.0}


def lut(v: Column, max_int: float) -> Column:
    """Values to 0..255: 255 from max_int on, below it v * 255 / max_int rounded half to even.  A minimum has no effect."""
    return F.when(v >= max_int, F.lit(255)).otherwise(F.bround(v * F.lit(255.0 / max_int)).cast("int")).cast("int")


def threshold(df: DataFrame, t: float) -> DataFrame:
    return df.where(F.col("v") >= t)


def no_negative(v: Column) -> Column:
    return F.greatest(v, F.lit(0))


def normalise(v: Column, dtype: str) -> Column:
    """v as a share of its type's range; only uint8, uint16 and float32 have one."""
    return v * F.lit(SCALE[dtype])


def scale_shift(v: Column, scale: float, shift: float) -> Column:
    return v * F.lit(scale) + F.lit(shift)


def cast_truncate(v: Column, kind: str = "int") -> Column:
    """Casts towards zero."""
    return v.cast(kind)


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-v))


def block_percentiles(df: DataFrame, block: int, low: float, high: float, extent: tuple[int, int, int] | None = None) -> DataFrame:
    """bx, by, bz, p1, p2 of each block with voxels, over all of the block's places; missing ones count as zeros.

    extent: the grid's shape, where it isn't a multiple of the block: blocks at its ends have fewer places."""
    keyed = df.select(*[cell(a, block).alias(f"b{a}") for a in AXES], F.col("v").cast("double").alias("v"))
    counted = keyed.groupBy("bx", "by", "bz", "v").agg(F.count("*").alias("n"))
    places = F.lit(1)
    for a, most in zip(AXES, extent or (None,) * 3):
        places = places * (F.lit(block) if most is None else F.least(F.lit(block), F.lit(most) - F.col(f"b{a}") * block))
    zeros = keyed.groupBy("bx", "by", "bz").agg(F.count("*").alias("held")).select("bx", "by", "bz", (places - F.col("held")).alias("n")).where("n > 0").select("bx", "by", "bz", F.lit(0.0).alias("v"), "n")
    at = F.percentile("v", F.array(F.lit(low), F.lit(high)), F.col("n"))
    return counted.unionByName(zeros).groupBy("bx", "by", "bz").agg(at.alias("p")).select("bx", "by", "bz", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p2"))


def percentile_stretch(df: DataFrame, block: int, low: float = 0.05, high: float = 0.995, extent: tuple[int, int, int] | None = None) -> DataFrame:
    """Each block stretched between its percentiles to 0..255, truncated; scale is 1 where they are equal."""
    stats = block_percentiles(df, block, low, high, extent)
    keyed = df.select(*AXES, "v", *[cell(a, block).alias(f"b{a}") for a in AXES])
    scale = F.when(F.col("p2") > F.col("p1"), 1 / (F.col("p2") - F.col("p1"))).otherwise(F.lit(1.0))
    share = F.least(F.greatest((F.col("v") - F.col("p1")) * scale, F.lit(0.0)), F.lit(1.0))
    return keyed.join(stats, ["bx", "by", "bz"]).select(*AXES, (share * 255).cast("int").alias("v"))


def remap(df: DataFrame, mapping: DataFrame, column: str = "v") -> DataFrame:
    """Values replaced by mapping (old, new); others stay."""
    return df.join(mapping, df[column] == mapping["old"], "left").withColumn(column, F.coalesce("new", column)).select(df.columns)


def exclude_labels(df: DataFrame, labels: list[int], background: int = 0) -> DataFrame:
    return df.withColumn("v", F.when(F.col("v").isin(labels), F.lit(background)).otherwise(F.col("v")))


def zero_constant_sections(df: DataFrame, places: int, axis: str = "z") -> DataFrame:
    """Sections whose values are all equal become zero; places: those of a section, of which missing ones are zeros.

    The statistics are joined back, so a large section needs no window."""
    flat = df.groupBy(axis).agg(((F.min("v") == F.max("v")) & ((F.count("*") == places) | (F.max("v") == 0))).alias("flat"))
    return df.join(flat, axis).select(*AXES, F.when(F.col("flat"), F.lit(0)).otherwise(F.col("v")).alias("v"))


def crop_fraction(lo, hi, negative, positive):
    """Bounds after cutting fractions of each axis off its low and high end; the two must leave something."""
    out = []
    for low, high, n, p in zip(lo, hi, negative, positive):
        if n + p >= 1:
            raise ValueError("fractions leave nothing")
        out.append((low + int((high - low) * n), high - int((high - low) * p)))
    return [b[0] for b in out], [b[1] for b in out]


def _grid(df: DataFrame, lo, hi) -> DataFrame:
    """All places of a box: one row exploded axis by axis."""
    g = df.sparkSession.range(lo[0], hi[0]).select(F.col("id").cast("int").alias("x"))
    for a, low, high in (("y", lo[1], hi[1]), ("z", lo[2], hi[2])):
        g = g.withColumn(a, F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
    return g


def densify(df: DataFrame, lo, hi) -> DataFrame:
    """A row for every place of the half-open box, zero where there is none."""
    return _grid(df, lo, hi).join(df, list(AXES), "left").select(*AXES, F.coalesce("v", F.lit(0)).alias("v"))


def pad_constant(df: DataFrame, lo, hi, size: int, value: int = 0) -> DataFrame:
    """The box grown by size on each side, dense; places outside the old box hold value."""
    inside = F.lit(True)
    for a, low, high in zip(AXES, lo, hi):
        inside = inside & (F.col(a) >= low) & (F.col(a) < high)
    big = _grid(df, [c - size for c in lo], [c + size for c in hi])
    return big.join(df, list(AXES), "left").select(*AXES, F.when(inside, F.coalesce("v", F.lit(0))).otherwise(F.lit(value)).alias("v"))


def pad_reflect(df: DataFrame, lo, hi, size: int) -> DataFrame:
    """The box grown by size, dense; places outside mirror the inside about the edge voxel (size below the extent)."""
    big = _grid(df, [c - size for c in lo], [c + size for c in hi])
    for a, low, high in zip(AXES, lo, hi):
        c = F.col(a)
        big = big.withColumn(f"s{a}", F.when(c < low, 2 * low - c).when(c >= high, 2 * (high - 1) - c).otherwise(c).cast("int"))
    src = df.select(*[F.col(a).alias(f"s{a}") for a in AXES], "v")
    return big.join(src, ["sx", "sy", "sz"], "left").select(*AXES, F.coalesce("v", F.lit(0)).alias("v"))


def kept_blocks(df: DataFrame, mask: DataFrame, block: int, ds: int) -> DataFrame:
    """Blocks with a non-zero voxel whose part of the coarse mask isn't above zero throughout.

    mask: x, y, z, m of a grid downsampled by ds; its window runs from ceil(start / ds) to ceil(end / ds)."""
    some = df.where("v <> 0").select(*[cell(a, block).alias(f"b{a}") for a in AXES]).distinct()
    n = block // ds
    full = mask.where("m > 0").select(*[cell(a, n).alias(f"b{a}") for a in AXES]).groupBy("bx", "by", "bz").agg(F.count("*").alias("n")).where(F.col("n") == n**3)
    return some.join(full, ["bx", "by", "bz"], "left_anti")


def max_projection(df: DataFrame) -> DataFrame:
    return df.groupBy("x", "y").agg(F.max("v").alias("v"))


def downsample(df: DataFrame, k: int) -> DataFrame:
    """Every k-th voxel on each axis; no averaging."""
    on = F.lit(True)
    for a in AXES:
        on = on & (F.pmod(F.col(a), F.lit(k)) == 0)
    return df.where(on).select(*[cell(a, k).alias(a) for a in AXES], "v")


def upsample(df: DataFrame, k: int) -> DataFrame:
    """Each voxel repeated k times on each axis."""
    for a in AXES:
        df = df.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(a, (F.col(a) * k + F.col("o")).cast("int")).drop("o")
    return df.select(*AXES, "v")


def resample_nearest(df: DataFrame, lo, hi, source: float, target: float) -> DataFrame:
    """Nearest-voxel resampling from voxel size source to target: each new place takes the voxel that holds its centre."""
    new = [(int(low * source / target), int(high * source / target)) for low, high in zip(lo, hi)]
    g = _grid(df, [n[0] for n in new], [n[1] for n in new])
    for a in AXES:
        g = g.withColumn(f"s{a}", F.floor((F.col(a) + 0.5) * (target / source)).cast("int"))
    return g.join(df.select(*[F.col(a).alias(f"s{a}") for a in AXES], "v"), ["sx", "sy", "sz"]).select(*AXES, "v")


def mirror(df: DataFrame, axis: str, lo: int, hi: int) -> DataFrame:
    return df.withColumn(axis, (F.lit(lo + hi - 1) - F.col(axis)).cast("int"))


def transpose(df: DataFrame, order: tuple[str, str, str]) -> DataFrame:
    """Axis i takes the coordinate of order[i]."""
    return df.select(*[F.col(o).alias(a) for a, o in zip(AXES, order)], "v")


def shift_sections(df: DataFrame, shifts: DataFrame, axis: str, lo: int, hi: int, section: str = "z") -> DataFrame:
    """Sections moved along an axis by shifts (section, shift); what leaves the box is dropped.  The draw of shifts is an input."""
    return df.join(shifts, section, "left").withColumn(axis, (F.col(axis) + F.coalesce("shift", F.lit(0))).cast("int")).where((F.col(axis) >= lo) & (F.col(axis) < hi)).select(*AXES, "v")


def section_means(df: DataFrame, lo, hi, section: str = "z") -> DataFrame:
    """section, m: the mean of each section of the box that has voxels, over all its places."""
    places = 1
    for a, low, high in zip(AXES, lo, hi):
        places *= 1 if a == section else high - low
    return df.groupBy(section).agg((F.sum("v") / F.lit(float(places))).alias("m"))


def lower_contrast(df: DataFrame, sections: list[int], scale: float, lo, hi, section: str = "z") -> DataFrame:
    """Named sections of the box drawn towards their mean; they become dense, as their zeros move too, the others stay sparse."""
    named = F.col(section).isin(sections)
    moved = densify(df.where(named), lo, hi).where(named).join(section_means(df.where(named), lo, hi, section), section, "left")
    m = F.coalesce("m", F.lit(0.0))
    return df.where(~named).select(*AXES, F.col("v").cast("double").alias("v")).unionByName(moved.select(*AXES, (m + (F.col("v") - m) * scale).alias("v")))


def drop_sections(df: DataFrame, axis: str, at: int, n: int) -> DataFrame:
    """n sections from `at` on taken out, and the gap closed."""
    c = F.col(axis)
    return df.where((c < at) | (c >= at + n)).withColumn(axis, F.when(c >= at + n, c - n).otherwise(c).cast("int"))
