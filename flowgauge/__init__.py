"""Trade-flow toxicity analytics on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions that tasks run travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
