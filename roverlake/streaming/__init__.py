"""Structured Streaming jobs.

The keyed-state functions of these jobs run in Python workers on the
executors. The package is registered for pickling *by value*, so the
functions travel with the job and executors need no installed copy of
``roverlake`` (a cluster can still ship it with ``--py-files``).
"""

import sys

from pyspark import cloudpickle

import roverlake

if roverlake.__name__ not in getattr(cloudpickle.cloudpickle, "_PICKLE_BY_VALUE_MODULES", set()):
    cloudpickle.register_pickle_by_value(sys.modules[roverlake.__name__])
