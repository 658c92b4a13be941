"""Sample-based area estimation and time-series change analytics on Spark."""

import sys

from pyspark import cloudpickle

# the package's functions travel to the executors with their code, so that nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
