"""Market-data, news and post-trade analytics as lazy PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
