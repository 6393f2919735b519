"""Operators of a training-data pipeline over tables of documents and embeddings."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
