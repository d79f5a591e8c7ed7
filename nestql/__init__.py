"""nestql: a PySpark-native engine for a T-SQL-flavoured dialect with nested results."""

from nestql.plans.syntax import ParseError, QueryError
from nestql.session import Session

__all__ = ["ParseError", "QueryError", "Session"]
