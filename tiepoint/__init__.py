"""Image-correspondence analytics and corpus operators on PySpark.

Functions that run on executors are shipped by value, so that workers need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
