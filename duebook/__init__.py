"""Repeating-charge analytics over bank and card statements, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need nothing
# installed beyond PySpark, numpy, pandas and Arrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
