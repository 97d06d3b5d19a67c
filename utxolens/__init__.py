"""Fund-flow analytics over UTXO ledgers, and corpus operators, as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
