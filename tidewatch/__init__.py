"""Stream and batch analytics on Spark: sentiment, access logs, trending
topics, machine outliers, action selection and run metrics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run inside tasks travel with their code, so that executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
