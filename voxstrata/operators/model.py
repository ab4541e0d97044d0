"""Block models: dense blocks through a pluggable function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxstrata.functions.boxes import AXES
from voxstrata.operators.tiling import halo

Model = Callable[[np.ndarray], np.ndarray]


def box_filter(a: np.ndarray) -> np.ndarray:
    """The deterministic stand-in for a network: sum over the 27 places around each voxel, zero outside."""
    p = np.pad(a, 1)
    n = a.shape
    return sum(p[i : i + n[0], j : j + n[1], k : k + n[2]] for i in range(3) for j in range(3) for k in range(3))


def apply_model(voxels: DataFrame, model: Model, block: int, margin: int) -> DataFrame:
    """x, y, z, p: the model's output on each block with a voxel, computed with a halo and cropped to the block.  Zeros are left out.

    A group is one block with its halo: (block + 2 margin) ** 3 places."""
    size = block + 2 * margin

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = [int(pdf[f"b{a}"].iloc[0]) * block - margin for a in AXES]
        cube = np.zeros((size,) * 3)
        cube[tuple(pdf[a].to_numpy() - o for a, o in zip(AXES, low))] = pdf["v"]
        out = model(cube)[(slice(margin, margin + block),) * 3]
        at = np.nonzero(out)
        return pd.DataFrame({a: (i + o + margin).astype(np.int32) for a, i, o in zip(AXES, at, low)} | {"p": out[at].astype(float)})

    return halo(voxels.select(*AXES, "v"), block, margin).groupBy("bx", "by", "bz").applyInPandas(lambda pdf: run(pdf), "x int, y int, z int, p double")


def apply_windows(windows: DataFrame, model: Model, size: int) -> DataFrame:
    """wx, wy, wz, x, y, z, p: the model's output at every place of each window of rows (wx, wy, wz, x, y, z, v).

    A group is one window: size ** 3 places.  Windows may overlap; each has its own output."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = [int(pdf[f"w{a}"].iloc[0]) for a in AXES]
        cube = np.zeros((size,) * 3)
        cube[tuple(pdf[a].to_numpy() - o for a, o in zip(AXES, low))] = pdf["v"]
        out = model(cube)
        at = np.indices(out.shape).reshape(3, -1)
        return pd.DataFrame({f"w{a}": np.full(out.size, o, np.int32) for a, o in zip(AXES, low)} | {a: (i + o).astype(np.int32) for a, i, o in zip(AXES, at, low)} | {"p": out.ravel().astype(float)})

    rows = windows.select(*[f"w{a}" for a in AXES], *AXES, "v")
    return rows.groupBy("wx", "wy", "wz").applyInPandas(lambda pdf: run(pdf), "wx int, wy int, wz int, x int, y int, z int, p double")


def random_model(seed: int) -> Model:
    """A fixed random 3x3x3 convolution with a sigmoid, for tests of the model contract."""
    k = np.random.default_rng(seed).normal(size=(3, 3, 3))

    def run(a: np.ndarray) -> np.ndarray:
        p, n = np.pad(a, 1), a.shape
        s = sum(k[i, j, m] * p[i : i + n[0], j : j + n[1], m : m + n[2]] for i in range(3) for j in range(3) for m in range(3))
        return 1 / (1 + np.exp(-s))

    return run
