"""All registered queries: importing the catalog modules fills ``QUERIES`` and ``SQL``."""
from . import catalog  # noqa: F401
from . import catalog_rules  # noqa: F401
from . import catalog_vectors  # noqa: F401
from . import catalog_more  # noqa: F401
from . import catalog_probes  # noqa: F401
from . import catalog_sources  # noqa: F401
from . import catalog_rollup  # noqa: F401
from . import catalog_terms  # noqa: F401
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
