"""Transcript-corpus analytics and speech-recognition scoring on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions travel to the executors by value, so a cluster needs no copy of
# this package on its workers.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
