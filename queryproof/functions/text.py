r"""Text expressions over statement and document columns.

Patterns use only what both the JVM and RE2 understand alike (``\s`` is spelled out).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\f\r]"

# SQL comments.
BLOCK_COMMENT = r"(?s)/\*.*?\*/"
LINE_COMMENT = r"--[^\n\r]*"


def strip(text: Column) -> Column:
    """Without leading and trailing white space."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def collapse(text: Column) -> Column:
    """White space runs become one blank, ends are stripped."""
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, BLOCK_COMMENT, " "), LINE_COMMENT, " ")


def normalize(text: Column) -> Column:
    """Comments removed, white space collapsed, lower case."""
    return F.lower(collapse(without_comments(F.coalesce(text, F.lit("")))))


def without_qualifiers(text: Column) -> Column:
    """Names without the table or alias before their dot."""
    return F.regexp_replace(text, r"[a-z_][a-z0-9_]*\.([a-z_])", "$1")
