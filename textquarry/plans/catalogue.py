"""All registered queries and the SQL that must give the same rows."""
from __future__ import annotations

from . import catalogues, documents, library, relational, retrieval

PARTS = (retrieval, relational, documents, catalogues, library)
QUERIES = {k: q for p in PARTS for k, q in p.C.queries.items()}
ORACLES = {k: o for p in PARTS for k, o in p.C.oracles.items()}
