"""stormgrid: weather objects in gridded time series, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so that executors do not
# need this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
