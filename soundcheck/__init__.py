"""soundcheck: is this data complete, usable and unaltered?

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); see README.md.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
