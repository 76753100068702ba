"""Readers and payload parsers.  Inputs arrive as files; there is no network layer."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
