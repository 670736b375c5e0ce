"""Message-triage analytics as PySpark DataFrame transformations."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the executors by value, so those need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
