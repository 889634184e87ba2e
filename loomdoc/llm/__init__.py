"""Training-data operators: near-duplicates, quality, archives, mixing, media, scans.

Functions of this subpackage travel to the executors by value, so a cluster
needs numpy and pyarrow there but no copy of this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
