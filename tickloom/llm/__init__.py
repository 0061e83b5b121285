"""Operators of a training-data pipeline: mixing, de-duplication, filters, search, token files.

Nothing else in the library imports this subpackage. Its functions are pickled by value, so Python
workers need the third-party libraries but not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
