"""Load profiling of metered time series on Spark.

Readings come in, groups of meters with a similar rhythm come out. Every
operator is a plain function from DataFrame to DataFrame; see ``wattloom.plans``
for the assembled job.
"""

import sys

from pyspark import cloudpickle

from wattloom.schema import READINGS, ProfileConfig

# Ship the package's own functions inside the job, so executors need only numpy and Arrow.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["READINGS", "ProfileConfig"]
