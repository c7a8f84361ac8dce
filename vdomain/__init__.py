"""Variable-domain annotation of protein sequences on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them: no archive has to be shipped to a cluster.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
