"""Analytics over text and source-code corpora, written as Spark plans.

Functions of this package are shipped to executors by value, so a cluster needs no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
