"""Operators for cleaning, scoring and mixing training text."""

import sys

from pyspark import cloudpickle

# functions of this folder travel with their tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
