"""glare: headline-style analytics on Spark.

Functions of this package that run inside Python workers (``mapInPandas``
bodies) are pickled by value, so executors need no installed copy.
"""
import sys as _sys

try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except ImportError:  # pragma: no cover - older cloudpickle
    pass
