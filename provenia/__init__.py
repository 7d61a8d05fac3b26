"""Provenia: evidence retrieval, resolution and auditing over large document collections on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
