"""newsmill: tables of news items, built and maintained with Spark."""

import sys

from pyspark import cloudpickle

# The few Python functions that run on executors travel with the job, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
