"""Hierarchical, weighted drill-down analytics on Spark.

Functions that run on executors are pickled by value, so executors need no
copy of this package on their path.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
