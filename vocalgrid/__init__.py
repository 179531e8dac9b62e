"""Spark-first operators for corpora of paired image sequences and audio."""

import sys

from pyspark import cloudpickle

# Kernels travel to the Python workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
