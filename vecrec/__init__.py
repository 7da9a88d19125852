"""PySpark-native engine for curating, aggregating, searching and clustering entity embeddings."""

import sys

from pyspark import cloudpickle

from vecrec.session import build_session, cut_lineage

# Arrow helpers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "cut_lineage"]
