"""Operators for training-data pipelines. Nothing else in the library imports this
subpackage; ``queries`` registers one query per operator.

The functions that run in tasks travel by value, so executors need no copy of the package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
