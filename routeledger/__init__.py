"""API posture analytics on Spark: endpoints, registries, provenance and findings."""

import sys

from pyspark import cloudpickle

from .plans.batch import compare, new_unauthenticated, remediation, run_batch
from .plans.scan import scan

# The few functions that run in Python workers travel with the job, so executors
# need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["compare", "new_unauthenticated", "remediation", "run_batch", "scan"]
