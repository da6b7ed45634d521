"""leadmill: lead preparation and corpus preparation as Spark DataFrame jobs.

Functions that run inside tasks are pickled by value, so executors need only
PySpark, pandas and numpy: the package itself is not installed on them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
