"""Spatial single-cell analytics as Spark DataFrame functions.

Every table is long: cells keyed by ``cell_id``, counts keyed by ``(cell_id, gene)`` with absent meaning zero,
polygons as vertex rows, cell-to-cell communication as an edge list. Functions take and return DataFrames.
"""

import sys

from pyspark import cloudpickle

# functions of this package that run inside Python tasks travel with the job; executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
