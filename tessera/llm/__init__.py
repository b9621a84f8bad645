"""Training-data operators: one module for each, nothing else in the library imports them.

Functions of this subpackage travel to Python workers by value, so executors
need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
