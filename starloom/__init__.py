"""starloom: posterior-catalog, chain and sky-map analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: the few functions that run in Python
# workers travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
