"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

from pyspark import cloudpickle

import tidewell

# Functions that run on executors travel with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(tidewell)
