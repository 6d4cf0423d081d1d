"""Training-data operators. Nothing else in the library imports this subpackage.

Tasks carry the code of these modules with them, so executors need numpy,
pyarrow, sentencepiece and the like, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
