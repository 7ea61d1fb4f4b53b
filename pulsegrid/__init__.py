"""Session-keyed time-series analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from pulsegrid.timeline import Timeline

# Step rules run inside Python workers; ship them with the job instead of requiring an install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Timeline"]
