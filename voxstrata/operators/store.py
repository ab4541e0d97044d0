"""A skeleton store in Parquet: one row per skeleton, with its bounding box for pruning.

Rows are written in spatial order with the box columns beside the flat buffers, so
that a box query's predicates reach the files' statistics.  Deletes and overwrites
are files of their own, resolved by sequence number on read; nothing is rewritten.
Each write has a folder of its own and counts from the moment its name is in the
log: one that fails half-way changes nothing, and writers at the same time, who may
get the same number, lose nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxstrata.functions.boxes import AXES


def with_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ids."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def pack(nodes: DataFrame, key: str) -> DataFrame:
    """A row per skeleton: segid, box, n_vertices, vertices, edges, radius.  A skeleton's nodes are one row's arrays."""
    own = nodes.select(F.col(key).cast("long").alias("segid"), "id", *AXES, "radius", "parent", F.row_number().over(Window.partitionBy(key).orderBy("id")).alias("v"))
    placed = own.join(own.select("segid", F.col("id").alias("parent"), F.col("v").alias("u")), ["segid", "parent"], "left")
    place = F.struct("v", *AXES, "radius", "u")
    rows = placed.groupBy("segid").agg(*[F.min(a).cast("float").alias(f"min_{a}") for a in AXES], *[F.max(a).cast("float").alias(f"max_{a}") for a in AXES], F.count("*").cast("int").alias("n_vertices"), F.array_sort(F.collect_list(place)).alias("s"))
    edges = F.filter(F.transform("s", lambda t: F.struct(t["u"].alias("u"), t["v"].alias("v"))), lambda e: e["u"].isNotNull())
    return rows.select(
        "segid", *[f"{e}_{a}" for e in ("min", "max") for a in AXES], "n_vertices", F.transform("s", lambda t: F.struct(*[t[a].cast("float").alias(a) for a in AXES])).alias("vertices"), edges.alias("edges"), F.transform("s", lambda t: t["radius"].cast("float")).alias("radius")
    )


class SkeletonStore:
    """Parquet folders under one path: data/write=NAME, gone/write=NAME, and a log of what counts.

    shard: skeletons a file, at most about."""

    def __init__(self, spark: SparkSession, path: str, shard: int = 10_000):
        self.spark, self.path, self.shard = spark, path.rstrip("/"), shard

    def _raw(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{kind}")
        except Exception as e:  # a store without such rows yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _read(self, kind: str) -> DataFrame | None:
        """Rows of logged writes, with their sequence number and name.  The log has a row for each of the store's writes."""
        rows, log = self._raw(kind), self._raw("log")
        return None if rows is None or log is None else rows.join(log, "write")

    def _commit(self, write: str) -> None:
        log = self._raw("log")
        n = 1 if log is None else log.agg(F.max("seq")).first()[0] + 1
        self.spark.range(1).select(F.lit(write).alias("write"), F.lit(n).cast("long").alias("seq")).write.mode("append").parquet(f"{self.path}/log")

    def _put(self, skeletons: DataFrame, write: str) -> None:
        parts = max(1, -(-skeletons.count() // self.shard))
        skeletons.repartitionByRange(parts, "min_x", "min_y", "min_z").sortWithinPartitions("min_x", "min_y", "min_z").write.parquet(f"{self.path}/data/write={write}")

    def _drop(self, ids: DataFrame, write: str) -> None:
        ids.select(F.col("segid").cast("long").alias("segid")).distinct().write.parquet(f"{self.path}/gone/write={write}")

    def write(self, skeletons: DataFrame) -> None:
        """Appends skeletons, in spatial order."""
        self._put(skeletons, write := f"w-{uuid.uuid4().hex}")
        self._commit(write)

    def delete(self, ids: DataFrame) -> None:
        """ids: a column segid."""
        self._drop(ids, write := f"w-{uuid.uuid4().hex}")
        self._commit(write)

    def overwrite(self, skeletons: DataFrame) -> None:
        """Puts skeletons in the place of those with their ids, as one write."""
        write = f"w-{uuid.uuid4().hex}"
        self._put(skeletons, write)
        self._drop(skeletons.select("segid"), write)
        self._commit(write)

    def read(self) -> DataFrame:
        """Live rows, with the sequence number they were written under."""
        data, gone = self._read("data"), self._read("gone")
        if data is None:
            raise ValueError("the store is empty")
        if gone is None:
            return data.drop("write")
        # two writers may have taken one number: their names say which of them comes later
        last = gone.groupBy("segid").agg(F.max(F.struct("seq", "write")).alias("gone"))
        return data.join(last, "segid", "left").where(F.col("gone").isNull() | (F.struct("seq", "write") >= F.col("gone"))).drop("gone", "write")

    def by_box(self, lo, hi) -> DataFrame:
        """Live skeletons whose closed box overlaps or touches lo..hi; the comparison is a pushed-down filter on box columns."""
        on = F.lit(True)
        for a, low, high in zip(AXES, lo, hi):
            on = on & (F.col(f"min_{a}") <= high) & (F.col(f"max_{a}") >= low)
        return self.read().where(on)

    def by_id(self, ids: DataFrame) -> DataFrame:
        return with_ids(self.read(), ids, "segid")

    def manifest(self) -> DataFrame:
        """seq, box, n of the live rows of each write."""
        return self.read().groupBy("seq").agg(*[F.min(f"min_{a}").alias(f"min_{a}") for a in AXES], *[F.max(f"max_{a}").alias(f"max_{a}") for a in AXES], F.count("*").alias("n"))
