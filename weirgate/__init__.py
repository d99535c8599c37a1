"""Read, search and join data of many kinds of sources with Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Spark tasks travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .hub import Connection, Hub  # noqa: E402
from .session import build_session  # noqa: E402

__all__ = ["Connection", "Hub", "build_session"]
