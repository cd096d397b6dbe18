"""Memory of Python workers, which stay alive between tasks."""

from __future__ import annotations


def give_back() -> None:
    """Return what a finished task has freed to the system, so that an idle worker leaves room for the JVM."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(work):
    """A function on batches that gives memory back when it ends, if it has met any batch."""

    def wrapped(batches):
        met = False

        def noted():
            nonlocal met
            for batch in batches:
                met = True
                yield batch

        yield from work(noted())
        if met:
            give_back()

    return wrapped
