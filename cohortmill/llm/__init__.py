"""Operators for preparing language-model training data.

Functions of this package that run in Python workers are shipped with the task,
so the workers need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
