"""What a Python worker keeps from task to task.

Workers serve one operator after another; what one has remembered would only take memory from the next.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa

_clear: dict[str, Callable[[], None]] = {}
_owner: str | None = None


def keeps(owner: str, clear: Callable[[], None]) -> None:
    """Names the function that empties an operator's memo."""
    _clear[owner] = clear


def serve(owner: str) -> None:
    """Called by each task of an operator: empties what the others have kept, and gives back what earlier tasks left."""
    global _owner
    if _owner != owner:
        for name, clear in _clear.items():
            if name != owner:
                clear()
        _owner = owner
    trim()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def trim() -> None:
    """Gives the memory that is free in this process back to the system.  Workers stay between tasks, and allocators
    keep what was freed; an executor's memory is that of all its workers."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def trimmed(owner: str, f: Callable) -> Callable:
    """f(pdf) for applyInPandas, of an operator: what a group needed is given back before the next one."""

    @functools.wraps(f)
    def run(pdf):
        serve(owner)
        return f(pdf)

    return run
