"""tallyloom: evaluation analytics for model outputs, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so that executors
# need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
