"""Operators for preparing training text: thirteen operators, their queries and SQL."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to executors with their code, which need not be installed there.
register_pickle_by_value(sys.modules[__name__])
