"""Operators for preparing training text. Nothing outside this subpackage imports it, so it can be left out.

Functions that run in tasks are sent to the executors with the job, so the
executors need this package neither installed nor on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
