"""docloom: document collections, filters, ranked text search and exact
nearest-neighbour search as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel inside the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
