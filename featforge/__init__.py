"""featforge: data preparation and feature building as plain Spark jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
expression), so operators chain with ``df.transform`` and run wherever the
session runs.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
