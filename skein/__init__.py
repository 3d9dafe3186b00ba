"""Skein: transcripts to a knowledge graph, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions given to mapInPandas or mapInArrow travel with the task, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
