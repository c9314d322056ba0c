"""Objects shared with Python workers."""

from __future__ import annotations

import pickle
import sys
import types

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def worker_cache() -> dict:
    """Kept as long as the Python worker lives."""
    return sys.modules.setdefault("_loomgraph_cache", types.ModuleType("_loomgraph_cache")).__dict__


class Shared:
    """A broadcast object of a class that executors need not have; each worker unpacks it once."""

    def __init__(self, spark: SparkSession, value: object):
        self._b = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._key = f"shared-{self._b._jbroadcast.id()}"

    def __reduce__(self):
        return _restored, (self._b, self._key)


class _Restored:
    def __init__(self, b, key):
        self._b, self._key = b, key

    @property
    def value(self):
        c = worker_cache()
        if self._key not in c:
            for old in [k for k in c if isinstance(k, str) and k.startswith("shared-")][:-3]:
                del c[old]
            c[self._key] = pickle.loads(self._b.value)
        return c[self._key]


def _restored(b, key):
    return _Restored(b, key)
