"""Review analytics and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the tasks that use them, so that a cluster
# needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
