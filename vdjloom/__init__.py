"""Immune-receptor sequencing reads as Spark DataFrames.

Every operator is an ordinary ``DataFrame -> DataFrame`` function usable with
``df.transform``; see ``README.md`` for the map of modules.
"""

import sys

from pyspark import cloudpickle

# Arrow helpers and the FASTQ source travel to the workers by value, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
