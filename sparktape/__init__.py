"""sparktape: market-tape analytics as plain Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
