"""carelens: care analytics and data preparation as Spark jobs.

Functions that run inside tasks travel by value with the job, so executors need not have this
package installed; the public libraries it uses (numpy, pandas, pyarrow) they do need.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
