"""Set-at-a-time Spark jobs for cited document retrieval and learner memory."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python helpers that run inside tasks travel with the job, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
