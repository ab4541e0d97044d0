"""Chunked array containers in the Zarr formats 2 and 3, in N5 and as precomputed volumes of several scales: scans and sinks, a task or group a chunk.

The metadata is one small JSON file, read and written by the driver.  A scan is a list
of chunk numbers, made by the executors, of which each row is read from its own file;
a chunk that isn't there holds the fill value throughout.  Codecs are those of the
formats that need no more than gzip, zlib and zstd; arrays have three axes or more, of
which those before the last three are fixed by ``at``.
"""

from __future__ import annotations

import gzip
import json
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES, cell, half_open
from voxstrata.functions.shared import materialised


def _file(path: str):
    return pafs.FileSystem.from_uri(path)


def _bytes(path: str) -> bytes | None:
    fs, where = _file(path)
    if fs.get_file_info(where).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(where, compression=None) as f:
        return f.read()


def _put(path: str, data: bytes) -> None:
    fs, where = _file(path)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(where, compression=None) as f:
        f.write(data)


def _zstd():
    import zstandard

    return zstandard


#: Codec names of the formats.
_UNPACK = {None: bytes, "gzip": gzip.decompress, "zlib": zlib.decompress, "zstd": lambda b: _zstd().ZstdDecompressor().decompressobj().decompress(b)}
_PACK = {None: bytes, "gzip": lambda b: gzip.compress(b, 5, mtime=0), "zlib": zlib.compress, "zstd": lambda b: _zstd().ZstdCompressor().compress(b)}


#: Array.version of N5 containers: big-endian blocks with a header, axes in reverse.
N5 = 5


@dataclass(frozen=True)
class Array:
    """What the metadata says; version is 2, 3 or N5."""

    path: str
    version: int
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codec: str | None = None
    fill: float = 0
    separator: str = "."
    order: str = "C"

    def chunk_path(self, at: tuple[int, ...]) -> str:
        if self.version == N5:
            return f"{self.path}/{'/'.join(map(str, at[::-1]))}"
        key = self.separator.join(map(str, at))
        return f"{self.path}/{key}" if self.version == 2 else f"{self.path}/c{self.separator}{key}"

    def decode(self, data: bytes) -> np.ndarray:
        if self.version == N5:
            mode, axes = (int.from_bytes(data[k : k + 2]) for k in (0, 2))
            shape = tuple(int.from_bytes(data[k : k + 4]) for k in range(4, 4 + 4 * axes, 4))[::-1]
            body = np.frombuffer(_UNPACK[self.codec](data[4 + 4 * axes + 4 * (mode == 1) :]), np.dtype(self.dtype))
            cube = np.full(self.chunks, self.fill, self.dtype)  # blocks at an end may be cut
            cube[tuple(map(slice, shape))] = body.reshape(shape)
            return cube
        return np.frombuffer(_UNPACK[self.codec](data), np.dtype(self.dtype)).reshape(self.chunks, order=self.order)

    def encode(self, cube: np.ndarray) -> bytes:
        data = _PACK[self.codec](cube.astype(self.dtype, copy=False).tobytes(order=self.order))
        if self.version != N5:
            return data
        return b"".join(n.to_bytes(k) for n, k in [(0, 2), (cube.ndim, 2), *[(s, 4) for s in cube.shape[::-1]]]) + data

    def metadata(self) -> tuple[str, dict]:
        """Name and content of the metadata file."""
        if self.version == N5:
            kind = {"type": self.codec or "raw"} | ({"level": 5, "useZlib": False} if self.codec == "gzip" else {})
            return "attributes.json", {"dimensions": list(self.shape[::-1]), "blockSize": list(self.chunks[::-1]), "dataType": np.dtype(self.dtype).name, "compression": kind}
        if self.version == 2:
            return ".zarray", {"zarr_format": 2, "shape": list(self.shape), "chunks": list(self.chunks), "dtype": self.dtype, "compressor": self.codec and {"id": self.codec}, "fill_value": self.fill, "order": self.order, "filters": None, "dimension_separator": self.separator}
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}] + [{"name": self.codec, "configuration": {"level": 5} if self.codec == "gzip" else {}}] * bool(self.codec)
        return "zarr.json", {
            "zarr_format": 3, "node_type": "array", "shape": list(self.shape), "data_type": np.dtype(self.dtype).name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.chunks)}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": self.separator}}, "fill_value": self.fill, "codecs": codecs, "attributes": {},
        }


def open_array(path: str) -> Array:
    """Reads the metadata of any of the formats."""
    path = path.rstrip("/")
    if (old := _bytes(f"{path}/.zarray")) is not None:
        m = json.loads(old)
        if m.get("filters"):
            raise ValueError("filters aren't read")
        codec = m["compressor"] and m["compressor"]["id"]
        found = Array(path, 2, tuple(m["shape"]), tuple(m["chunks"]), m["dtype"], codec, m["fill_value"] or 0, m.get("dimension_separator", "."), m["order"])
    elif (new := _bytes(f"{path}/zarr.json")) is not None:
        m = json.loads(new)
        codecs = [c["name"] for c in m["codecs"]]
        if codecs[0] != "bytes" or len(codecs) > 2:
            raise ValueError(f"codecs that aren't read: {codecs}")
        endian = ">" if m["codecs"][0].get("configuration", {}).get("endian") == "big" else "<"
        found = Array(path, 3, tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), np.dtype(m["data_type"]).newbyteorder(endian).str, codecs[1] if len(codecs) == 2 else None, m["fill_value"] or 0, m["chunk_key_encoding"].get("configuration", {}).get("separator", "/"))
    elif (n5 := _bytes(f"{path}/attributes.json")) is not None and "dimensions" in (m := json.loads(n5)):
        kind = m["compression"]
        codec = None if kind["type"] == "raw" else "zlib" if kind.get("useZlib") else kind["type"]
        found = Array(path, N5, tuple(m["dimensions"][::-1]), tuple(m["blockSize"][::-1]), np.dtype(m["dataType"]).newbyteorder(">").str, codec)
    else:
        raise FileNotFoundError(path)
    if found.codec not in _UNPACK:
        raise ValueError(f"a codec that isn't read: {found.codec}")
    return found


def read_array(spark: SparkSession, path: str, at: tuple[int, ...] | None = None, lo: tuple | None = None, hi: tuple | None = None) -> DataFrame:
    """x, y, z, v of the places in the half-open box lo..hi whose value isn't zero; at: places on the axes before the last three.

    Only chunks that the box touches are read.  The last three axes are x, y and z."""
    a = open_array(path)
    extra = len(a.shape) - 3
    at = at or (0,) * extra
    lo, hi = lo or (0, 0, 0), tuple(min(h, s) for h, s in zip(hi or a.shape[extra:], a.shape[extra:]))
    kind = "long" if np.issubdtype(np.dtype(a.dtype), np.integer) else "double"
    ends = [(low // c, -(-high // c)) for low, high, c in zip(lo, hi, a.chunks[extra:])]
    n = [max(0, e - s) for s, e in ends]

    def run(batches):
        for b in batches:
            for number in b.column(0).to_pylist():
                where = [s + i for (s, _), i in zip(ends, np.unravel_index(number, n))]
                data = _bytes(a.chunk_path((*(p // c for p, c in zip(at, a.chunks)), *where)))
                cube = np.full(a.chunks[extra:], a.fill, a.dtype) if data is None else a.decode(data)[tuple(p % c for p, c in zip(at, a.chunks))]
                first = [w * c for w, c in zip(where, a.chunks[extra:])]
                inner = [slice(max(low - f, 0), max(0, min(high - f, c))) for low, high, f, c in zip(lo, hi, first, a.chunks[extra:])]
                part = cube[tuple(inner)]
                spots = np.nonzero(part)
                cols = [pa.array((i + s.start + f).astype(np.int32)) for i, s, f in zip(spots, inner, first)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(part[spots].astype(np.int64 if kind == "long" else np.float64))], ["x", "y", "z", "v"])

    count = int(np.prod(n))
    chunks = spark.range(0, count, 1, max(1, min(count, 100_000)))
    return chunks.mapInArrow(run, f"x int, y int, z int, v {kind}")


def _claimed(path: str, overwrite: bool) -> None:
    """Refuses a folder that holds anything, or empties it."""
    fs, where = _file(path)
    if fs.get_file_info(where).type == pafs.FileType.NotFound or not fs.get_file_info(pafs.FileSelector(where)):
        return
    if not overwrite:
        raise FileExistsError(path)
    fs.delete_dir_contents(where)


def _chunk_rows(voxels: DataFrame, shape, chunks, every: bool) -> DataFrame:
    """x, y, z, v, cx, cy, cz of the voxels in the half-open box of the shape; with every, also a row without a place for each chunk."""
    inside = F.lit(True)
    for a, most in zip(AXES, shape):
        inside = inside & (F.col(a) >= 0) & (F.col(a) < most)
    keyed = voxels.where(inside).select(*[F.col(a).cast("int").alias(a) for a in AXES], "v", *[cell(a, c).alias(f"c{a}") for a, c in zip(AXES, chunks)])
    if not every:
        return keyed.where("v <> 0")
    n = [-(-s // c) for s, c in zip(shape, chunks)]
    i = F.col("id")
    at = (F.floor(i / (n[1] * n[2])), F.floor(i / n[2]) % n[1], i % n[2])
    blank = voxels.sparkSession.range(n[0] * n[1] * n[2]).select(*[F.lit(None).cast("int").alias(a) for a in AXES], F.lit(0).cast(voxels.schema["v"].dataType).alias("v"), *[c.cast("int").alias(f"c{a}") for c, a in zip(at, AXES)])
    return keyed.unionByName(blank)


def _write_chunks(rows: DataFrame, chunks, dtype: str, put) -> DataFrame:
    """path, n of the chunks that put(where, cube) writes, a group a chunk; places without a row are zeros."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        where = tuple(int(pdf[f"c{a}"].iloc[0]) for a in AXES)
        pdf = pdf[pdf["x"].notna()]
        cube = np.zeros(chunks, dtype)
        cube[tuple(pdf[a].to_numpy(np.int64) - w * c for a, w, c in zip(AXES, where, chunks))] = pdf["v"].to_numpy().astype(dtype)
        return pd.DataFrame({"path": [put(where, cube)], "n": [len(pdf)]})

    return rows.groupBy("cx", "cy", "cz").applyInPandas(lambda pdf: run(pdf), "path string, n long")


def write_array(voxels: DataFrame, array: Array, overwrite: bool = False) -> DataFrame:
    """Writes x, y, z, v of the half-open box of the array's shape, of three axes; returns path, n (rows) of the chunks that were written.

    A place without a row is zero, whatever the fill value: where that is 0, chunks without rows aren't written, else all are.
    A folder that holds files is refused, or emptied first with overwrite.  A group is one chunk; a retry
    writes the same file again."""
    if len(array.shape) != 3 or array.codec not in _PACK:
        raise ValueError("three axes, and a codec that is written")

    def put(where, cube):
        path = array.chunk_path(where)
        _put(path, array.encode(cube))
        return path

    _claimed(array.path, overwrite)
    name, content = array.metadata()
    _put(f"{array.path}/{name}", json.dumps(content).encode())
    return _write_chunks(_chunk_rows(voxels, array.shape, array.chunks, array.fill != 0), array.chunks, array.dtype, put)


def halved(voxels: DataFrame) -> DataFrame:
    """x, y, z, v of the next scale: the mean of each 2 x 2 x 2 places, rounded down, missing ones being zeros; zeros get no row."""
    at = [F.floor(F.col(a) / 2).cast("int").alias(a) for a in AXES]
    return voxels.groupBy(*at).agg(F.floor(F.sum("v") / 8).cast("long").alias("v")).where("v <> 0")


def write_precomputed(voxels: DataFrame, path: str, shape, chunks=(64, 64, 64), dtype: str = "uint8", resolution=(1, 1, 1), scales: int = 1, cutout=None, overwrite: bool = False) -> DataFrame:
    """Writes a precomputed volume of several scales, each made of the one before by means of two; returns scale, path, n of the chunks written.

    cutout: (lo, hi) of the part that is written, moved to the origin; it halves with each scale.  Chunks without a voxel
    aren't written, readers take them for zeros."""
    lo, hi = cutout or ((0, 0, 0), tuple(shape))
    kind = np.dtype(dtype).newbyteorder("<").str
    size = [h - low for low, h in zip(lo, hi)]
    level = voxels.where(half_open(lo, hi)).select(*[(F.col(a) - low).cast("int").alias(a) for a, low in zip(AXES, lo)], "v")
    _claimed(path, overwrite)
    told, out = [], None
    for n in range(scales):
        at = [r << n for r in resolution]
        key = "_".join(map(str, at))
        told.append({"key": key, "size": list(size), "resolution": at, "voxel_offset": [0, 0, 0], "chunk_sizes": [list(chunks)], "encoding": "raw"})
        level = materialised(level, f"scale{n}")

        def put(where, cube, key=key, size=tuple(size)):
            ends = [(w * c, min(w * c + c, s)) for w, c, s in zip(where, chunks, size)]
            name = f"{path}/{key}/" + "_".join(f"{a}-{b}" for a, b in ends)
            _put(name, cube[tuple(slice(0, b - a) for a, b in ends)].tobytes(order="F"))  # x is fastest
            return name

        done = _write_chunks(_chunk_rows(level, size, chunks, False), tuple(chunks), kind, put).withColumn("scale", F.lit(n))
        out = done if out is None else out.unionByName(done)
        level, size = halved(level), [max(1, s // 2) for s in size]
    info = {"@type": "neuroglancer_multiscale_volume", "type": "image", "data_type": np.dtype(dtype).name, "num_channels": 1, "scales": told}
    _put(f"{path}/info", json.dumps(info).encode())
    return out.select("scale", "path", "n")


def read_precomputed(spark: SparkSession, path: str, scale: int = 0) -> DataFrame:
    """x, y, z, v of a scale's places whose value isn't zero, a task's row a chunk; raw encoding, one channel."""
    info = json.loads(_bytes(f"{path}/info") or b"{}")
    if not info:
        raise FileNotFoundError(path)
    told = info["scales"][scale]
    if told["encoding"] != "raw" or info["num_channels"] != 1:
        raise ValueError("raw encoding and one channel are read")
    size, chunks, offset = told["size"], told["chunk_sizes"][0], told["voxel_offset"]
    n = [-(-s // c) for s, c in zip(size, chunks)]
    dtype = np.dtype(info["data_type"]).newbyteorder("<")
    kind = "long" if np.issubdtype(dtype, np.integer) else "double"

    def run(batches):
        for b in batches:
            for number in b.column(0).to_pylist():
                ends = [(int(w) * c, min(int(w) * c + c, s)) for w, c, s in zip(np.unravel_index(number, n), chunks, size)]
                data = _bytes(f"{path}/{told['key']}/" + "_".join(f"{a + o}-{e + o}" for (a, e), o in zip(ends, offset)))
                if data is not None:
                    cube = np.frombuffer(data, dtype).reshape([e - a for a, e in ends], order="F")
                    spots = np.nonzero(cube)
                    cols = [pa.array((i + a + o).astype(np.int32)) for i, (a, _), o in zip(spots, ends, offset)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(cube[spots].astype(np.int64 if kind == "long" else np.float64))], ["x", "y", "z", "v"])

    count = int(np.prod(n))
    return spark.range(0, count, 1, max(1, min(count, 100_000))).mapInArrow(run, f"x int, y int, z int, v {kind}")
