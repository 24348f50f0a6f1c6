"""Operators of a training-data pipeline; nothing else in the package imports this folder.

The folder is pickled by value, so executors need NumPy and Arrow but no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
