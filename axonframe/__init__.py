"""axonframe: experiment analytics (tables, logs, rasters) as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from axonframe.session import get_spark

# Functions that run in Python workers travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark"]
