"""Sums of fixed-size vectors over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers in one block: each is summed by a task of its own.
BLOCK = 1 << 12


def cut(total: np.ndarray) -> pd.DataFrame:
    """A vector as rows (block, c) of its blocks that aren't all zero."""
    rows = [(lo, total[lo : lo + BLOCK].tobytes()) for lo in range(0, len(total), BLOCK) if total[lo : lo + BLOCK].any()]
    return pd.DataFrame(rows, columns=["block", "c"])


def joined(blocks: DataFrame, size: int, kind: str, add: Callable = np.add) -> np.ndarray:
    """The vector of ``size`` numbers that rows (block, c) of all tasks add up to.

    A group streams its rows and holds one block, whatever the number of tasks; only the sum, whose size is fixed,
    reaches the driver.
    """

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for c in b.column("c"):
                x = np.frombuffer(c.as_buffer(), kind)
                total = x.copy() if total is None else add(total, x, out=total)
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "c": pa.array([total.tobytes()], pa.binary())})

    # the worker reads the types to see that the batches are to be streamed
    fold.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    out = np.zeros(size, kind)
    for r in blocks.select("block", "c").groupBy("block").applyInArrow(fold, "block int, c binary").collect():
        x = np.frombuffer(r.c, kind)
        out[r.block : r.block + len(x)] = x
    return out
