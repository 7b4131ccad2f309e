"""quarry: a small analytics engine on PySpark."""

from .catalog import Catalog
from .engine import Engine
from .errors import EngineError, SyntaxProblem, TableExists, TableMissing
from .session import build_session
from .types import TYPES, ddl_type, field

__all__ = ["TYPES", "Catalog", "Engine", "EngineError", "SyntaxProblem", "TableExists", "TableMissing", "build_session", "ddl_type", "field"]
