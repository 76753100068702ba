"""Scalar functions as Column expressions.  All run in the JVM but for the few named in `python_udfs`."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
