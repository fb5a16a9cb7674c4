"""A Spark-native engine for searching, refreshing and analysing a corpus of notes."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel by value, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
