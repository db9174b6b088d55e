"""Retrieval and answer pipelines as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with their code, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
