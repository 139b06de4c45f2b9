"""ESG measurements as Spark jobs: ingest, rules, change log, queries, statistics and models."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
