"""Register analytics on Spark: pure DataFrame -> DataFrame operators over
append-only registers of property sales, rents, construction readings and
asking-price scans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their code, so that executors
# need no copy of the package on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
