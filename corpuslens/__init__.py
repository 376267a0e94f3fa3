"""corpuslens: text-corpus analytics on PySpark.

Functions of this package that run in Python workers travel with the task
(pickled by value), so workers need not have the package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
