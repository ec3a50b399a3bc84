"""Column expressions on white space, digits and case that do not depend on the session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's Unicode white space, no-break spaces included.
SPACES = r"(?U)\s+"
#: Decimal digits of the Arabic-Indic and the extended Arabic-Indic block.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"


def squeeze(col: Column) -> Column:
    """Runs of white space made one space, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def blank_to_null(col: Column) -> Column:
    """Null for null, empty or only white space."""
    return F.when(squeeze(col) != "", col)


def fold_digits(col: Column) -> Column:
    """Arabic-Indic digits as 0-9."""
    return F.translate(col, ARABIC_DIGITS, ASCII_DIGITS)


def folded_key(col: Column) -> Column:
    """Lower-cased and squeezed; null where nothing is left. The comparison key of names."""
    return F.nullif(F.lower(squeeze(col)), F.lit(""))
