"""Plumbing shared by the operators: staging, Arrow access, and memory that workers give back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..memory import tidy, trim
from ..staging import checkpoint_folder, packed, settle, stage

__all__ = ["checkpoint_folder", "packed", "partitions_for", "pieces", "settle", "stage", "text_buffers", "tidy", "trim"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a string column; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    off = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(offsets: np.ndarray, limit: int):
    """Ranges of consecutive documents of about ``limit`` bytes (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def partitions_for(total: int, per_group: int, least: int = 8) -> int:
    """How many groups hold ``total`` entries at about ``per_group`` each."""
    return max(least, -(-int(total or 0) // per_group))
