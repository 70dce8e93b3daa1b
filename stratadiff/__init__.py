"""Analytics of software evolution on Spark, and operators for training-data pipelines."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to executors by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
