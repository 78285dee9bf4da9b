"""tonetide: Spark-native analytics for streams of short business texts."""

import sys

from pyspark import cloudpickle

# task code travels with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
