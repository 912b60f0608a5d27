"""Analytics over time-stamped activity memory, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Small helpers that run inside tasks travel with the task, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
