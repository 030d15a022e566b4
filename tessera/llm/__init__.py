"""Operators for preparing training data: one module per operator.

Nothing outside this subpackage imports it.  Functions that run on executors
are shipped by value, so a worker does not need the repository on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
