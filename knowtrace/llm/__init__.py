"""Operators of a training-data pipeline; nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# tasks get this package's code with their functions, whatever is installed on the workers
register_pickle_by_value(sys.modules[__name__])
