"""Spark-native text analytics: recognition, linking and scoring of entity mentions."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves: they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
