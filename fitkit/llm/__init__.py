"""Operators for large text corpora: filtering, deduplication, privacy, tokens."""

import sys

from pyspark import cloudpickle

# Workers may start outside this folder, so the kernels travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
