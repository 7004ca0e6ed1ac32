"""Water-chemistry analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with their code, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
