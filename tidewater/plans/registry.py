"""All registered queries and their SQL."""

from __future__ import annotations

from . import behaviours, chain, composed, evaluations, features, inputs, linkage, merging, offline, pages, ranking, search, serving, training  # noqa: F401  (importing them registers their queries)

FLAGSHIP = "features_wide"
QUERIES = features.QUERIES
ORACLE_SQL = features.SQL
