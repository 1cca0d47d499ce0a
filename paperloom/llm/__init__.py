"""Operators for preparing language-model training data; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions for executors are pickled with the code they use, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules["paperloom"])
