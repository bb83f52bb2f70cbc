"""framewise: a lazy, chainable analytics library on Spark DataFrames."""

import os
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers import the package if they find it on their path; else functions travel with their code.
if os.path.dirname(os.path.dirname(os.path.abspath(__file__))) not in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
