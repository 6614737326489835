"""Tidewell: reproducible analytics tables and training-data operators on PySpark."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
