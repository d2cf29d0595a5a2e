"""Memory that Python workers give back."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable

import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def trim() -> None:
    """Give memory that is free back to the system: workers live on after a task, and what they keep adds up with the next one's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(f: Callable) -> Callable:
    """``f``, a function of batches (a generator) or of one group, with ``trim`` after each task or group."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            try:
                yield from f(batches)
            finally:
                trim()
    else:

        def run(table):
            try:
                return f(table)
            finally:
                trim()

    return run
