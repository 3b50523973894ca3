"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

import tidemark

# Text bytes that a Python task handles at once; a longer document is handled alone.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows holding about ``size`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(lengths, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


def ragged(arrays: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Arrays laid end to end, and where each one starts (one more entry than arrays)."""
    starts = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum([len(a) for a in arrays], out=starts[1:])
    return (np.concatenate(arrays).astype(dtype, copy=False) if arrays else np.zeros(0, dtype)), starts


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """The same DataFrame, after making sure that Python workers can import this package: Spark sends them
    its source files once per application."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(tidemark.__file__))
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as out:
            for folder, _, names in sorted(os.walk(top)):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
        local = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark_code.zip")
        with open(local, "wb") as f:
            f.write(packed.getvalue())
        context.addPyFile(local)
        _shipped.add(context.applicationId)
    return df
