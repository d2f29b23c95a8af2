"""Key columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks that may surround a key.
BLANKS = " \t\r\n"


def clean_key(col: Column | str) -> Column:
    """A UUID key in its clean form: without surrounding blanks and in lower case; null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(col, F.lit(BLANKS)))
