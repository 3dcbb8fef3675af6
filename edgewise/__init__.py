"""Graph analytics, pattern mining and data preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with their task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
