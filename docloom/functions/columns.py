"""Small helpers for functions that take columns or their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_quote(text: str) -> str:
    """text as a literal in a regular expression."""
    return "".join(c if c.isalnum() or c in "_ " or ord(c) > 127 else "\\" + c for c in text)
