"""chunkloom: a chunk-table engine written as Spark DataFrame jobs.

Documents become rows of one wide chunk table; taggers add attribute columns;
the table is explored with SQL predicates, grouped statistics, histograms and
lineage walks; recipes turn it into versioned Parquet data sets.
"""

import sys

from pyspark import cloudpickle

# Python workers receive the package's functions with the task, so executors
# need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
