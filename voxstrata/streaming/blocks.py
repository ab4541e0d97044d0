"""Voxel files as a stream: an extension, for volumes that arrive block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES, cell


def read_voxels(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema("x int, y int, z int, v int").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def upsert_max(stream: DataFrame, path: str, checkpoint: str):
    """Keeps the maximum per voxel: each batch writes its own reduced part under its id, so a repeated batch overwrites itself."""

    def put(batch: DataFrame, n: int) -> None:
        batch.groupBy(*AXES).agg(F.max("v").alias("v")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(*AXES).agg(F.max("v").alias("v"))


def block_counts(stream: DataFrame, block: int) -> DataFrame:
    """Voxels and sum per block so far; state is one row a block."""
    return stream.groupBy(*[cell(a, block).alias(f"b{a}") for a in AXES]).agg(F.count("*").alias("n"), F.sum("v").alias("s"))
