"""gridpulse: asset-telemetry analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gridpulse.catalog import Params, SIGNALS  # noqa: E402
from gridpulse.operators.series import Series  # noqa: E402

__all__ = ["Params", "SIGNALS", "Series"]
