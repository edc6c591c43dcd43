"""What the operators of this subpackage share: scratch tables, byte views of text columns, rolling hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on; arrays of eight bytes a position stay near 16 MB.
SLICE_BYTES = 1 << 21
#: An odd multiplier of a polynomial over 64-bit integers.
STEP = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back.

    Cuts the lineage: what follows starts from files that every executor can
    reach, so a lost executor costs a re-read only.
    """
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, n + 1 offsets) of a string or binary column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]] if len(column) else body[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mixing of each number; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int = 1) -> np.ndarray:
    """A 64-bit number for each byte."""
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(seed * 256)) * np.uint64(STEP))


def powers(n: int, base: int = STEP) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class RollingHash:
    """Hashes of any byte ranges of one array: prefix sums of codes times powers, shifted to a common power."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(n), out=self.sums[1:])
        self.inverse = powers(n + 1, pow(STEP, -1, 1 << 64))

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` bytes, by its start."""
        return mixed((self.sums[width:] - self.sums[:-width]) * self.inverse[:len(self.sums) - width])


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def binary_array(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from its bytes and offsets."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
