"""Operators for large text corpora: tokens, pages, shards, scores, duplicates, leaks and search."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
