"""Spark-native scanning of source code for exposed secrets."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel with their code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
