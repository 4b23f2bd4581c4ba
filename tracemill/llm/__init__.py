"""Operators for preparing training corpora at scale, with their queries and SQL twins."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
