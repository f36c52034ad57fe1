"""logweave: operational-data analytics (logs, code, service graphs) as Spark jobs.

Every operator is a function from DataFrame(s) to DataFrame built on Spark SQL
expressions, windows, joins and Structured Streaming.
"""

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (applyInPandas,
# mapInArrow) are shipped by value, so executors need no installed copy.
try:  # pragma: no cover - depends on the bundled cloudpickle
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
