"""What tasks in Python workers share: slices of bounded size, one kept state, and memory given back."""

from __future__ import annotations

ROWS = 1000  # rows of an Arrow batch that carries texts
_HELD: dict = {}


def small_batches(spark) -> None:
    """Texts can be long: from now on this session sends Python at most ``ROWS`` rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ROWS:
        spark.conf.set(key, str(ROWS))


def held(key, make):
    """What a worker keeps for its next tasks of the same kind; it keeps one thing at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def slices(texts, most: int, rows: int = 2000):
    """``(offset, length)`` of runs of an Arrow text column with about ``most`` bytes each, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        upto = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + most, side="right"))))
        yield at, upto - at
        at = upto


def release() -> None:
    """Free what this worker no longer uses, so that an idle worker does not hold its task's peak."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it decides by itself
        pass


def tidy(run, keeps: bool = False):
    """``run`` over batches; at the end of the task the worker's memory goes back to the system.

    Unless it ``keeps`` something, what tasks of another kind left in the worker goes before it begins.
    """

    def tidied(batches):
        if not keeps:
            _HELD.clear()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
