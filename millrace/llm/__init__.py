"""Operators for preparing language-model training data, one module each.

Nothing outside this package imports it.  The queries over the standard tables
are in ``millrace.llm.queries``.
"""

import sys

from pyspark import cloudpickle

# Tasks carry this package's functions by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
