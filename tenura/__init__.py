"""Retention analytics for subscription businesses, expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions and classes of this package travel to the executors themselves, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
