"""Passagework: measuring document-retrieval pipelines with Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python functions travel to executors by value, so a cluster needs no copy of
# this package on its workers' import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
