"""longpanel: point-in-time panel analytics on Spark DataFrames.

The unit of data is the long ``(ts, symbol, values...)`` panel and the raw order and trade
event tables behind it.  Every operator takes and returns Spark DataFrames.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions sent to tasks travel by value, so executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
