"""Small helpers for operators that run over Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch that are Python objects at a time.
ROWS = 256


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def spare(df: DataFrame, name: str) -> str:
    """A name that no column of the table has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column, ``ROWS`` made at a time; null is the empty text."""
    for k in range(0, len(column), ROWS):
        for x in column.slice(k, ROWS).to_pylist():
            yield "" if x is None else x


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a column's strings, one at a time; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column's strings in one array, and where each begins and the last ends."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]
