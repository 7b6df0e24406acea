"""Operators for preparing language-model training data."""

import sys

from pyspark import cloudpickle

# Ship task functions of this package with the tasks: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
