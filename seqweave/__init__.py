"""Analytics over ordered, circular sequences, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
