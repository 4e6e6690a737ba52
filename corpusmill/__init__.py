"""Spark-first corpus analytics, retrieval and training-data operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are shipped by value, so a cluster needs no
# installed copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
