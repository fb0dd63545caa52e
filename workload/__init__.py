"""The registered queries and their SQL counterparts."""

import sys

from pyspark import cloudpickle

# As for the package itself: executors get the stand-in models with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
