"""Column metadata for catalogues of tables, on Spark."""

import sys

from pyspark import cloudpickle

#: Functions go to the executors with their code, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
