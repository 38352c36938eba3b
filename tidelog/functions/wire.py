"""Big-endian fields of many binary values at once: numbers, and texts as Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary_buffer(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary array, and where each value begins and ends."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    raw = data.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), offsets[:-1], offsets[1:]


def number_at(buf: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    found = np.zeros(len(at), np.int64)
    for k in range(n):
        found = (found << 8) | buf[at + k]
    return found


def gathered(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    ends = np.cumsum(size)
    return buf[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def texts(flat: np.ndarray, size: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A string array of texts that stand one after the other; what is not valid is null."""
    bounds = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    mask = pa.array(valid).buffers()[1] if valid is not None and len(valid) else None
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat)), mask)


def damaged_texts(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[int]:
    """Which spans are not UTF-8; only those with a byte above 127 are looked at one by one."""
    high = np.concatenate(([0], np.cumsum(buf >= 128, dtype=np.int64)))
    found = []
    for k in np.flatnonzero(high[first + size] > high[first]).tolist():
        try:
            buf[first[k] : first[k] + size[k]].tobytes().decode("utf-8")
        except UnicodeDecodeError:
            found.append(k)
    return found


class Cursor:
    """A place in each of many values, moved over all of them together; what would read beyond its value is not ``ok``."""

    def __init__(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.buf, self.at, self.end = buf, begin.copy(), end
        self.ok = np.ones(len(begin), bool)

    def skip(self, rows: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Move ``rows`` on by n bytes: those that have them, and where they were."""
        here = self.at[rows]
        fits = (here + n <= self.end[rows]) & self.ok[rows]
        self.ok[rows[~fits]] = False
        self.at[rows] = np.where(fits, here + n, here)
        return fits, here

    def number(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The next number of n bytes of each of the rows; 0 where there is none."""
        fits, here = self.skip(rows, n)
        found = np.zeros(len(rows), np.int64)
        found[fits] = number_at(self.buf, here[fits], n)
        return found

    def span(self, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First byte and size of the text of each row, whose length is a number of n bytes; size 0 where there is none."""
        size = self.number(rows, n)
        fits, here = self.skip(rows, size)
        return here, np.where(fits, size, 0)
