"""A Spark-first engine for interval-annotated calls and the relational work around them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# what runs in Python workers travels with the job: executors need no copy of this package
register_pickle_by_value(sys.modules[__name__])
