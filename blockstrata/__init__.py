"""Snapshot analytics on Spark: nested binary game saves as tables, kept as content-addressed versions."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel by value with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
