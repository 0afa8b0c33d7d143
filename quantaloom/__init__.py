"""Semantic-ID analytics on Spark: build, assign, join and measure discrete item codes."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to tasks carry their code along, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
