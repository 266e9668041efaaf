"""Reuse of fixed column-expression lists.

Building a wide projection from Python costs one JVM round trip per function
call; the case projections have hundreds. Their expressions are unresolved and
depend only on the column names, so they are built once per SparkContext and
reused by every plan (resolution happens per DataFrame, as usual).
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark import SparkContext

_CACHE: dict[tuple[Hashable, Hashable], object] = {}


def _context_key() -> Hashable:
    # Application id and start time identify a context even after another one
    # replaced it (a Python ``id`` may be reused once the old object is freed).
    sc = SparkContext._active_spark_context
    return (sc.applicationId, sc.startTime) if sc is not None else None


def columns_once(key: Hashable, build: Callable[[], object]):
    """``build()`` for ``key`` once per live SparkContext."""
    context = _context_key()
    k = (context, key)
    if k not in _CACHE:
        # Expressions of a context that has ended are of no use any more.
        for old in [o for o in _CACHE if o[0] != context]:
            del _CACHE[old]
        _CACHE[k] = build()
    return _CACHE[k]
