"""Meet every row of one side with every row of the other in bounded blocks.

Both sides are hashed into blocks, each pair of blocks becomes one task input of
bounded size, and the task returns a reduced result. No pair is ever emitted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str, n_left, n_right):
    """Cogroups of one block of each side. Block counts are numbers or columns of the side."""

    def spread(df, key, own, other, n_own, n_other):
        number = F.pmod(F.xxhash64(key), F.lit(n_own) if isinstance(n_own, int) else n_own).cast("int")
        last = (F.lit(n_other) if isinstance(n_other, int) else n_other) - 1
        return df.withColumn(own, number).withColumn(other, F.explode(F.sequence(F.lit(0), last.cast("int"))))

    def fresh(df):
        # Both sides may come from one table; new column ids keep them apart.
        return df.select(*[F.col(c).alias(c) for c in df.columns])

    a = spread(fresh(left), left_key, "_lb", "_rb", n_left, n_right)
    b = spread(fresh(right), right_key, "_rb", "_lb", n_right, n_left)
    keys = [*by, "_lb", "_rb"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys))


def as_matrix(column, width: int | None = None) -> np.ndarray:
    """Arrow list column of equally long vectors as a matrix; NULL vectors become zero rows.

    Vectors of other lengths, or of another length than ``width``, are an error.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    n, lengths = len(column), np.unique(column.value_lengths().drop_null().to_numpy(zero_copy_only=False))
    if width is None:
        width = int(lengths[0]) if len(lengths) else 0
    if np.any(lengths != width):
        raise ValueError(f"vectors of {width} numbers expected, found lengths {lengths[:5].tolist()}")
    if column.null_count == 0:
        return flat.reshape(n, width)
    valid = np.asarray(column.is_valid())
    out = np.zeros((n, width))
    out[valid] = flat.reshape(int(valid.sum()), width)
    return out


def as_lists(matrix: np.ndarray) -> pa.Array:
    """Matrix rows as an Arrow list column."""
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
