"""Repeated-survey community analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions go to the workers with their code, so these need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
