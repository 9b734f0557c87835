"""Operators for training-data pipelines: archives, quality, duplicates, tokenizing, leaks and personal data."""

import sys

from pyspark import cloudpickle

import querytide.errors

# Executors have no copy of this package: what tasks run is sent with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(querytide.errors)
