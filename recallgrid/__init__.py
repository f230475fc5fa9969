"""Record retrieval, keyed upserts and retrieval evaluation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors inside the tasks, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
