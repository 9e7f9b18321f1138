"""Trajectory analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions that run on executors carry their code: a cluster needs numpy, pandas and pyarrow there, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
