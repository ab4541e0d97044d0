"""Readers and writers of foreign files: SWC, tar of SWC, gzipped arrays, CSV points, JSON specs."""

from __future__ import annotations

import gzip
import io
import tarfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWC = "id int, type int, x double, y double, z double, radius double, parent int"
_FIELDS = ("id", "type", "x", "y", "z", "radius", "parent")


def _swc_columns(line):
    t = F.split(F.trim(line), r"\s+")
    kinds = ("int", "int", "double", "double", "double", "double", "int")
    number = lambda k, kind: F.expr(f"try_cast(try_cast(t[{k}] as double) as {kind})")
    return t, [number(k, kind).alias(n) for k, (n, kind) in enumerate(zip(_FIELDS, kinds))]


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """file and the seven SWC columns of each node; comment lines and lines of other than 7 or 8 tokens are skipped."""
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    t, cols = _swc_columns(F.col("value"))
    return lines.where(~F.trim("value").startswith("#")).select("file", t.alias("t")).where(F.size("t").isin(7, 8)).select("file", *cols)


def write_swc(nodes: DataFrame, path: str, by: str) -> None:
    """A folder per value of `by`, space-separated rows in id order: x, y, z rounded to whole numbers, radius to three places."""
    row = F.format_string("%d %d %.0f %.0f %.0f %.3f %d", *[F.col(c).cast("double" if c in ("x", "y", "z", "radius") else "int") for c in _FIELDS])
    nodes.repartition(by).sortWithinPartitions(by, "id").select(by, row.alias("value")).write.partitionBy(by).text(path)


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (1.. in member order), member and SWC columns of tar or tar.gz archives; an archive is a task's work, read as a stream."""
    schema = "file string, ordinal int, member string, value string"

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as tar:
                    k = 0
                    for m in tar:
                        if m.isfile():
                            k += 1
                            rows = [x for x in tar.extractfile(m).read().decode().splitlines() if x.strip() and not x.lstrip().startswith("#")]
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([k] * len(rows), pa.int32()), pa.array([m.name] * len(rows), pa.string()), pa.array(rows, pa.string())], ["file", "ordinal", "member", "value"])

    lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
    t, cols = _swc_columns(F.col("value"))
    return lines.select("file", "ordinal", "member", t.alias("t")).where(F.size("t").isin(7, 8)).select("file", "ordinal", "member", *cols)


def tar_bytes(nodes: DataFrame, tree: str) -> DataFrame:
    """name, content: a tar.gz of one SWC member per tree of each partition, as binary rows."""

    def run(batches):
        out, last, text = io.BytesIO(), None, []
        with tarfile.open(fileobj=out, mode="w:gz") as tar:

            def close():
                if last is not None:
                    data = "".join(text).encode()
                    info = tarfile.TarInfo(f"{last}.swc")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))

            for b in batches:
                for t, *row in zip(*[c.to_pylist() for c in b.columns]):
                    if t != last:
                        close()
                        last, text = t, []
                    text.append("%d %d %.0f %.0f %.0f %.3f %d\n" % tuple(row))
            close()
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"{last}.tar.gz"]), pa.array([out.getvalue()], pa.binary())], ["name", "content"])

    return nodes.select(tree, *_FIELDS).repartition(tree).sortWithinPartitions(tree, "id").mapInArrow(run, "name string, content binary")


def read_npy_gz(spark: SparkSession, path: str) -> DataFrame:
    """file, x, y, z, v of the non-zero places of gzipped .npy volumes of three dimensions, emitted slab by slab."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.load(io.BytesIO(gzip.decompress(content)))
                for x in range(a.shape[0]):
                    y, z = np.nonzero(a[x])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(y), pa.string()), pa.array(np.full(len(y), x, np.int32)), pa.array(y.astype(np.int32)), pa.array(z.astype(np.int32)), pa.array(a[x][y, z].astype(np.float64))], ["file", "x", "y", "z", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, x int, y int, z int, v double")


def npy_gz(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a)
    return gzip.compress(out.getvalue(), mtime=0)


def read_points(spark: SparkSession, path: str, columns=(0, 1, 2), scale=(1.0, 1.0, 1.0), id_column: int | None = None, delimiter: str = ",") -> DataFrame:
    """id, x, y, z of CSV points; a first line that isn't numbers is a header.  Without an id column rows get increasing ids, unique but not dense."""
    rows = spark.read.text(path).select(F.split("value", delimiter).alias("t"))
    at = [F.expr(f"try_cast(trim(t[{k}]) as double)") * s for k, s in zip(columns, scale)]
    ident = F.expr(f"try_cast(trim(t[{id_column}]) as long)") if id_column is not None else F.monotonically_increasing_id()
    return rows.select(ident.alias("id"), *[c.alias(a) for c, a in zip(at, ("x", "y", "z"))]).where("x is not null and y is not null and z is not null")


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """filename and lo_/hi_ of the bounding box of each entry of a JSON list."""
    schema = "filename string, bounding_box array<array<int>>"
    corner = lambda k, p: [F.col("bounding_box")[k][i].alias(f"{p}_{a}") for i, a in enumerate(("x", "y", "z"))]
    return spark.read.schema(schema).option("multiLine", True).json(path).select("filename", *corner(0, "lo"), *corner(1, "hi"))


def split_store_path(uri):
    """Columns bucket and key of s3://bucket/key or https://bucket.s3.../key."""
    plain, host = r"^s3a?://([^/]+)/?(.*)$", r"^https?://([^./]+)\.s3[^/]*/?(.*)$"
    part = lambda k: F.when(uri.rlike(plain), F.regexp_extract(uri, plain, k)).when(uri.rlike(host), F.regexp_extract(uri, host, k))
    return part(1), part(2)
