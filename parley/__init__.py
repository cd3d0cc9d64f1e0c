"""Conversation analytics as Spark DataFrame and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# task functions carry their helpers with them, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
