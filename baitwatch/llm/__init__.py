"""Operators of a training-data pipeline. Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so this folder need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
