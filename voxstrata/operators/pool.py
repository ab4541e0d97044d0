"""One index over the sliding windows of many volumes, and draws that a seed fixes.

Volumes (volume, x0, y0, z0, x1, y1, z1) are half-open boxes.  A volume's windows are
numbered with z fastest; the pool numbers those of all volumes one after the other, by
running sums within ranges of volumes and over one row a range.  Windows that are asked
for by number meet their volume by an equi-join on stretches of the numbering.  Draws
take a number in 0..1 from the seed and the row's key, so they don't depend on the order
of rows or on how often a task is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxstrata.functions.boxes import AXES
from voxstrata.functions.shared import materialised
from voxstrata.operators.tiling import integral_image

#: Window numbers that share a key in the join of numbers and volumes.
STRETCH = 4096


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number from 0 to less than 1, by the first 32 bits of the MD5 of `<seed>:<key>:...`."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def pooled(volumes: DataFrame, size: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """The volumes with nx, ny, nz (windows along each axis), n, and first, the number of each one's first window, in the order of volume."""
    counts = {f"n{a}": F.greatest(F.floor((F.col(f"{a}1") - F.col(f"{a}0") - s) / t) + 1, F.lit(0)).cast("long") for a, s, t in zip(AXES, size, stride)}
    rows = volumes.withColumns(counts).withColumn("n", F.col("nx") * F.col("ny") * F.col("nz"))
    ranges = int(volumes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialised(rows.repartitionByRange(ranges, "volume").withColumn("range", F.spark_partition_id()), "pool")
    sums = rows.groupBy("range").agg(F.sum("n").alias("held"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("range", F.coalesce(F.sum("held").over(before(Window.orderBy("range"))), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("n").over(before(Window.partitionBy("range").orderBy("volume"))), F.lit(0))
    return rows.join(F.broadcast(ahead), "range").withColumn("first", F.col("ahead") + own).drop("range", "ahead")  # a row a range


def _corner(rows: DataFrame, size, stride) -> DataFrame:
    """number, volume, x0 .. z1 of windows, from rows of pooled with i, the window's number in its volume."""
    i = F.col("i")
    at = (F.floor(i / (F.col("ny") * F.col("nz"))), F.floor(i / F.col("nz")) % F.col("ny"), i % F.col("nz"))
    low = [(F.col(f"{a}0") + k * t).cast("int") for a, k, t in zip(AXES, at, stride)]
    return rows.select((F.col("first") + i).alias("number"), "volume", *[low_.alias(f"{a}0") for a, low_ in zip(AXES, low)], *[(low_ + s).cast("int").alias(f"{a}1") for a, low_, s in zip(AXES, low, size)])


def all_windows(pool: DataFrame, size, stride) -> DataFrame:
    """number, volume, x0 .. z1 of every window of the pool."""
    return _corner(pool.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))), size, stride)


def windows_at(numbers: DataFrame, pool: DataFrame, size, stride) -> DataFrame:
    """The windows of the numbers (column number); numbers beyond the pool get no row."""
    some = pool.where("n > 0").withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / STRETCH), F.floor((F.col("first") + F.col("n") - 1) / STRETCH))))
    met = numbers.select("number", F.floor(F.col("number") / STRETCH).alias("stretch")).join(some, "stretch").where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n")))
    return _corner(met.withColumn("i", F.col("number") - F.col("first")), size, stride)


def aligned(layers: dict[str, DataFrame], windows: DataFrame, side: int = 64) -> DataFrame:
    """number, layer, x, y, z, v: what each of several volumes of one extent holds in the windows (number, x0 .. z1); places count from the window's corner.

    Voxels and windows meet in cells of `side` places."""
    cells = windows
    for a in AXES:
        cells = cells.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / side), F.floor((F.col(f"{a}1") - 1) / side))))
    out = None
    for name, df in layers.items():
        keyed = df.select(*AXES, "v", *[F.floor(F.col(a) / side).alias(f"c{a}") for a in AXES])
        met = keyed.join(cells, [f"c{a}" for a in AXES])
        for a in AXES:
            met = met.where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")))
        rows = met.select("number", F.lit(name).alias("layer"), *[(F.col(a) - F.col(f"{a}0")).cast("int").alias(a) for a in AXES], "v")
        out = rows if out is None else out.unionByName(rows)
    return out


def valid_windows(labels: DataFrame, windows: DataFrame, side: int = 64) -> DataFrame:
    """number of the windows in which the label volume holds anything but zeros."""
    return aligned({"labels": labels.where("v <> 0")}, windows, side).select("number").distinct()


def chosen(keys: DataFrame, key: str, shares: list[float], seed: int) -> DataFrame:
    """keys with choice: which of several providers serves each key, by shares that needn't sum to 1."""
    total, so_far, pick = float(sum(shares)), 0.0, F.lit(len(shares) - 1)
    u = uniform(seed, key)
    ends = []
    for s in shares[:-1]:
        so_far += s / total
        ends.append(so_far)
    for n in range(len(ends) - 1, -1, -1):
        pick = F.when(u < ends[n], n).otherwise(pick)
    return keys.withColumn("choice", pick)


def drawn(rows: DataFrame, weight: str, n: int, seed: int, keys: list[str]) -> DataFrame:
    """n rows (all, if there are fewer of positive weight) drawn without putting back, a row's chance each time being its share of the weights left.

    Each row waits for a time with an exponential distribution of its weight as rate; the first n are taken.  Only n rows
    of each partition leave it.  keys tell rows apart; ties go to the smaller keys."""
    wait = -F.log(1 - uniform(seed, *keys)) / F.col(weight)
    return rows.where(F.col(weight) > 0).withColumn("wait", wait).orderBy("wait", *keys).limit(n).drop("wait")


def masked_locations(mask: DataFrame, size: tuple[int, int, int], lo, hi, least: float = 0.0) -> DataFrame:
    """x, y, z, n: lower corners of the boxes of a size within the half-open box lo..hi whose mask (x, y, z, v, of every place, 0 or 1) holds n places,
    at least the share `least` of all; by eight values of the integral image each."""
    s = integral_image(mask)
    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    # the sum up to p counts for the box that begins after p, and for those that end at p
    told = F.array(*[F.struct(*[(F.col(x) + 1 - d * k).cast("int").alias(x) for x, d, k in zip(AXES, o, size)], F.lit(1 if sum(o) % 2 else -1).alias("sign")) for o in corners])
    sums = s.select(F.explode(told).alias("t"), "s").select("t.*", "s").groupBy(*AXES).agg(F.sum(F.col("sign") * F.col("s")).cast("long").alias("n"))
    inside = F.lit(True)
    for a, low, h, k in zip(AXES, lo, hi, size):
        inside = inside & (F.col(a) >= low) & (F.col(a) + k <= h)
    return sums.where(inside & (F.col("n") >= least * size[0] * size[1] * size[2]))
