"""docquarry: document retrieval and grounded question answering on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with their tasks, so workers need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from docquarry.config import EngineConfig  # noqa: E402
from docquarry.engine import Engine  # noqa: E402

__all__ = ["Engine", "EngineConfig"]
