"""emberlog: log analytics as Spark DataFrame programs.

Raw log files become one canonical event table; everything else is a query
over that table.  Every public function takes and returns DataFrames and leaves
the physical plan to Catalyst.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that Spark ships to executors carry the library's code with them, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
