"""Document-desk analytics as DataFrame-to-DataFrame functions on Spark."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions for executors are pickled with the code they use, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
