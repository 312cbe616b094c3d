"""Evaluation analytics on Spark: questions, responses, scores and reports as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from . import functions, operators, plans, registry, sinks, sources, streaming  # noqa: E402
from .session import local_session, shared_folder  # noqa: E402

__all__ = [
    "functions", "operators", "plans", "registry", "sinks", "sources", "streaming",
    "local_session", "shared_folder",
]
