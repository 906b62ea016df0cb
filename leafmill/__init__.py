"""leafmill: documentation corpora from source-repository trees, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with their task, so the executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
