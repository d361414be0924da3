"""Operators for training-data pipelines over the corpus tables.

Nothing else in the library imports this subpackage. Functions that run inside tasks are pickled by
value, so executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
