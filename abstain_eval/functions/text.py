"""Column helpers for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c) -> Column:
    """Remove white space of any kind from both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(WHITESPACE))


def normalised(c) -> Column:
    return F.lower(strip(c))


def blank_to_null(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(strip(c) != "", c)


def json_string(value: Column) -> Column:
    """A text as a quoted JSON string."""
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
