"""spindrel: directory analytics and large-scale record cleaning on PySpark.

The core packages (`sources`, `functions`, `operators`, `plans`, `streaming`)
never import `spindrel.llm`; that subpackage may be removed without harm.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

#: Python operators travel to the executors by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
