"""Voxel-table analytics on Spark.

Volumes, label maps and region masks are tables keyed by ``case_id`` and voxel
coordinates; every measure is a DataFrame transformation over all cases at once.
"""

import sys

from pyspark import cloudpickle

# Kernels travel to the workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
