"""Question-bank analytics on PySpark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
