"""Log analytics as PySpark DataFrame and Structured Streaming jobs.

Timestamps are ``timestamp_ntz`` columns holding UTC everywhere; call
:func:`configure` once per session so that parsing agrees with that.
"""

import sys

from pyspark import cloudpickle

from tracewell.session import configure, cut_lineage, drop_stage, shared_dir

# Functions sent to executors carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "cut_lineage", "drop_stage", "shared_dir"]
