"""Training-data operators: each module holds one operator, `queries` registers them."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
