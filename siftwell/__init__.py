"""Curation, scoring and survey analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Row helpers travel with their tasks, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
