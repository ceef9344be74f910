"""docpool: versioned document collections and multi-signal retrieval on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# functions travel to the executors whole, which then need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
