"""scholia: literature retrieval and analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
