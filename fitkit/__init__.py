"""fitkit: fit linear models on partitioned Spark DataFrames.

Tables go in as DataFrames with a label ``y``, a feature array ``x`` and, where a
method works shard by shard, an integer column ``shard``.  Weights and histories
come out as DataFrames.
"""

import sys

from pyspark import cloudpickle

# Kernels run in Python workers that may not have this package installed, so its
# functions are shipped inside the task closure instead of by import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
