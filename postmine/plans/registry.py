"""Name -> query callable and name -> DuckDB oracle SQL."""

from __future__ import annotations

from . import queries as Q
from .oracle import oracle_sql

QUERIES = {
    name[2:]: fn for name, fn in vars(Q).items() if name.startswith("q_") and callable(fn)
}
ORACLE = {k: v for k, v in oracle_sql().items() if k in QUERIES}
