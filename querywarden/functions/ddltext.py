"""Column functions on table files: a row-count header, the DDL, and an index section behind a marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text format of table files.
INDEX_MARKER = "-- === Index Statistics (auto-collected) ==="
ROWS_HEADER = "-- Estimated Rows: "


def strip_all(text: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def index_section(content: Column) -> Column:
    """From the marker to the end; null without a marker."""
    at = F.instr(content, INDEX_MARKER)
    return F.when(at > 0, strip_all(F.substring(content, at, F.length(content))))


def ddl_section(content: Column) -> Column:
    """Header and DDL, without the index section."""
    at = F.instr(content, INDEX_MARKER)
    return strip_all(F.when(at > 0, F.substring(content, F.lit(1), at - 1)).otherwise(content))


def estimated_rows(content: Column) -> Column:
    """Row estimate of the header, 0 when absent or not a number."""
    digits = F.regexp_extract(content, r"(?i)--\s*Estimated Rows:\s*(\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def bare_ddl(content: Column) -> Column:
    """DDL without the row-count header."""
    return strip_all(F.regexp_replace(ddl_section(content), r"^--\s*Estimated Rows:\s*\d+\s*", ""))


def table_file(rows: Column, ddl: Column) -> Column:
    """Header, blank line and DDL, as written for one table."""
    return F.concat(F.lit(ROWS_HEADER), rows.cast("string"), F.lit("\n\n"), ddl, F.lit("\n"))
