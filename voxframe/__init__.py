"""Speech-corpus and dialogue analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python kernels travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
