"""Surrogate-model data engine: plain PySpark DataFrame jobs from raw table to monitored model."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code with them, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
