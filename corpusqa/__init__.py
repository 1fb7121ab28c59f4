"""Document retrieval and question answering over large text collections, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
