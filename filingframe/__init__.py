"""Spark-native analytics for corporate filings and market data.

Every operator takes columns or DataFrames and returns columns or DataFrames;
nothing here starts a session, reads a clock or keeps global state.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run on executors travel with the job, so that executors need
# no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
