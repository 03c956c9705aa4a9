"""leagueflow: league and squad analytics as Spark DataFrame operators."""

import sys as _sys

try:  # ship grouped-map helpers by value, so executors need no installed package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
