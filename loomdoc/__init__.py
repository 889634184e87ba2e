"""Document analytics on PySpark: selectors, text search, revision trees, change feeds.

Functions of this package travel to the executors by value, so a cluster needs
no copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
