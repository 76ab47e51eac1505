"""Training-data operators.

Ten operators over ``documents``, ``pages`` and ``benchmark`` tables, their
registered queries (``queries.py``) and the corpus pipeline's building blocks.
Nothing else in the library imports this package.

Functions that run in Python workers are shipped with the job, so executors
need no copy of this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
