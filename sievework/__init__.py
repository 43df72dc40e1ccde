"""sievework: free-text record labelling, entity linking and corpus audits as Spark plans."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so it need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
