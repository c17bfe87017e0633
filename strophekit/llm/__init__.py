"""Operations of a training-data pipeline, one module per operator.

Nothing outside this package imports it.  Task functions are pickled by value,
so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
