"""The registered queries: name -> (Spark plan, the same as ANSI SQL)."""

from . import engine_queries, registry
from .registry import flagship

PLANS = registry.PLANS | engine_queries.PLANS
ORACLE = registry.ORACLE | engine_queries.ORACLE

__all__ = ["ORACLE", "PLANS", "flagship"]
