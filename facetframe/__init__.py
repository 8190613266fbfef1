"""Exploratory analytics on Spark DataFrames: load, profile, test, chart, mine."""

import sys

from pyspark import cloudpickle

# Functions of the package travel to the Python workers whole, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
