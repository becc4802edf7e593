"""Conversation-archive analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Workers receive the package's Arrow functions by value and need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
