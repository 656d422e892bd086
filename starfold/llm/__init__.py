"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Worker functions travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
