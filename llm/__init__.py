"""Training-data operators: each module holds one operator, ``queries`` registers them.

Functions that run in tasks travel with their code, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
