"""docgauge: evaluation analytics on Spark DataFrames.

Prediction logs, reference answers and required question sets are typed
DataFrames; scoring, comparison, sampling, audits and resampling are plans.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need
# no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
