"""meridian: a Spark-first engine for record linkage, geospatial evidence and corpus preparation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
