"""loomnet: corpus-to-network analytics as Spark plans.

Functions of this package that reach Python workers are pickled by value, so that
executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
