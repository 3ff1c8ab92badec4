"""raincask: verification and post-processing of gridded rainfall forecasts on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no install of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
