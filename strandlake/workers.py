"""Functions for Python workers that are found by name, so that they needn't be pickled with their module."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def on_workers(fn: Callable, *args, **kwargs) -> Callable:
    """fn with further arguments, imported where it runs; module-level caches outlive a task."""
    module, name, root = fn.__module__, fn.__qualname__, ROOT

    def run(*first):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        out = getattr(importlib.import_module(module), name)(*first, *args, **kwargs)
        return importlib.import_module("strandlake.workers").tidied(out) if hasattr(out, "__next__") else out

    return run


def tidied(out):
    """The results of a task; then what it has freed goes back to the system, as the worker waits for other tasks."""
    try:
        yield from out
    finally:
        give_back()


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
    except (ImportError, OSError, AttributeError):  # another C library
        pass
