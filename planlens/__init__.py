"""planlens: Spark-native analytics over multi-step tool plans."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of this package: functions shipped to
# Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
