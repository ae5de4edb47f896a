"""Skeinwork: a Spark-native engine for turning documents into a queryable property graph."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
