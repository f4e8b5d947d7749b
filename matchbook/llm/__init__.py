"""Operators of a training-data pipeline: formatting, filtering, de-duplication,
mixing and token output over large document tables.

Nothing outside this package imports it.  Its functions travel to the executors by
value, so a cluster needs the public libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
