"""Document retrieval analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel inside the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
