"""Training-data operators: de-duplication, filtering, extraction, tokenizing, sharding and packing.

Nothing else in the library imports this package. Functions that run inside
Spark tasks are shipped with the job (pickled by value), so executors need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
