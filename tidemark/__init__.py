"""Demand-forecasting analytics as DataFrame-to-DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Arrow functions travel with their job, so executors need numpy and
# pandas but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
