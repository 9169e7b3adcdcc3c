"""petalstream: a Spark-first engine for building, measuring and querying text corpora."""

import sys

from pyspark import cloudpickle

# Functions handed to Python workers travel by value, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
