"""Spark-native retrieval, evaluation and corpus-preparation operators."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
