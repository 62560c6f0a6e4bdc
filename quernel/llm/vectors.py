"""Dense vectors as numpy matrices: which are usable, unit length, pseudo-random rotations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(c: str, dim: int) -> Column:
    """Whether a vector has ``dim`` finite values that are not all zero (false for null)."""
    v = F.col(c)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column without nulls, all of length ``dim``."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, normed to keep lengths; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


def padded(x: np.ndarray) -> np.ndarray:
    """``x`` with zeros up to a power of two columns."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    return x if d == x.shape[1] else np.pad(x, ((0, 0), (0, d - x.shape[1])))


@lru_cache(maxsize=256)
def rotation(dim: int, seed: int) -> np.ndarray:
    """The matrix of a pseudo-random rotation: three rounds of random signs and a fast Hadamard transform."""
    x = np.eye(dim, dtype=np.float32)
    for s in np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, dim)):
        x = hadamard(x * s)
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows rotated.  Up to 256 columns one product with the rotation's matrix beats the transform's passes."""
    dim = x.shape[1]
    if dim <= 256:
        return x @ rotation(dim, seed)
    for s in np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, dim)):
        x = hadamard(x * s)
    return x
