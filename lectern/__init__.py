"""lectern: text extraction, recognition refinement and corpus preparation as Spark jobs.

Functions that run in tasks are sent by value, so executors need the libraries they use but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
