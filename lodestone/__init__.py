"""Evidence-grounded retrieval and its evaluation, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors with everything of this package they use,
# so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
