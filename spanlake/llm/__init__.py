"""Operators of a training-data pipeline over documents, embeddings and conversations.

Functions that run inside tasks travel to the workers by value, so workers need numpy and pyarrow
but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
