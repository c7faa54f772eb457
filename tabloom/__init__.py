"""tabloom: build, encode, synthesise and judge tabular data with Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python tasks receive this package's functions with the job, so executors need no copy installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
