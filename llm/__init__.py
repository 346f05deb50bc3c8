"""Operators for preparing training text: dedup, filtering, scoring, mixing.

Nothing outside this package and corpus_pipeline.py imports it.
"""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the tasks, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
