"""Risk mining on large Spark tables: profiling, binning, testing, modelling, rules."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to Python workers by value, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
