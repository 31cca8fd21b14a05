"""matrixloom: analytics over annotated feature x observation matrices on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent along whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
