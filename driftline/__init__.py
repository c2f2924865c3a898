"""driftline: station-survey time-series analytics on Spark DataFrames.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column``) function built
from Spark's own expressions, aggregates and windows.
"""

__version__ = "0.1.0"
