"""A PySpark-native engine for code and text retrieval, curation and evaluation."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
