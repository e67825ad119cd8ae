"""Queries over the given tables, each with an oracle where SQL can express it."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# as in the library: functions reach the executors by value
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
