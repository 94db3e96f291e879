"""logloom: log normalisation, drift and rule-lifecycle analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
