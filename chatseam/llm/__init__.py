"""Operators for preparing training data, and the queries that apply them.

Nothing outside this package imports it. Functions sent to workers travel by value, so workers
need the third-party libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
