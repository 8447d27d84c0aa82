"""notewright: Spark table operators that label text notes and judge the labels."""

import sys

from pyspark import cloudpickle

from notewright.schema import LabelScheme

# Functions that Python workers run travel with their code, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["LabelScheme"]
