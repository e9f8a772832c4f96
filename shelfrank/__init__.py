"""shelfrank — retail sales ranking on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from public
PySpark APIs; jobs in :mod:`shelfrank.plans` chain them.
"""

from shelfrank.config import Params

__all__ = ["Params"]
