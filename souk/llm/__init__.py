"""Training-data pipeline operators (documents, pages, embeddings).

Nothing outside this package imports it; it only borrows the session helper of
``souk``. Every operator takes DataFrames and returns DataFrames; the contract
queries in ``registry`` derive their digest columns from the operators' outputs.
"""

import sys

from pyspark import cloudpickle

# Python tasks carry this package's functions with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
