"""Message-corpus analytics on PySpark.

Heterogeneous chat dumps become one canonical message table; text, vector and
actor views are computed on top of it. Everything is a lazy DataFrame
transformation unless its name says it writes or runs.
"""

from chatseam.session import prepare
from chatseam.specs import CorpusSpec, get_spec, load_specs

__all__ = ["CorpusSpec", "get_spec", "load_specs", "prepare"]
