"""Chunked-array processing and experiment-log analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel with the job, so the
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
