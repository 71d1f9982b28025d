"""Colored k-mer graphs and training-data operators on Spark DataFrames."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to executors travel with their code: the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
