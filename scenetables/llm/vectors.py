"""Integer vectors for the exact vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What 64-bit arithmetic may reach.
_MOST = 1 << 62
LONG_MAX = (1 << 63) - 1


def usable(vector: str) -> Column:
    """Whether a vector is there, without null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def scaled(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a long; what lies beyond 64 bits is held at their ends."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of an array column, all `width` long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact(terms: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are where `terms` squared differences of their items add up within 64 bits, else as Python integers."""
    most = max((max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size), default=0)
    return list(arrays) if 4 * most * most * max(1, terms) < _MOST else [a.astype(object) for a in arrays]


def as_longs(values: np.ndarray) -> pa.Array:
    """A column of longs; null where an integer does not fit."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(x) if x <= LONG_MAX else None for x in values], pa.int64())


def whole_sum(column: str) -> Column:
    """The sum of a column of longs; null where it does not fit, or where one of them is null."""
    return F.when(F.count_if(F.col(column).isNull()) == 0, F.try_sum(column))
