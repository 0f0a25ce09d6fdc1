"""Memory that a worker no longer needs goes back to the machine when its task ends: workers live on and would keep it."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For mapInArrow."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def lean_table(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """For applyInArrow on groups or co-groups; only after groups that were large."""

    def group(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            if table.nbytes > 1 << 20:
                give_back()

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            if left.nbytes + right.nbytes > 1 << 20:
                give_back()

    return pair if f.__code__.co_argcount == 2 else group
