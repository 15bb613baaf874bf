"""Operators of a large-scale training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package: what a Python stage runs travels with the stage.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
