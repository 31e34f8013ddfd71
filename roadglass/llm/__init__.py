"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
