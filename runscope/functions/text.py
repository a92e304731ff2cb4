"""Text helpers shared by the parsers."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

from runscope.formats import RUN_NAME_PATTERN


@cache
def _digits_of_all_scripts() -> tuple[str, str]:
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9; all-ASCII text takes the cheap branch."""
    source, target = _digits_of_all_scripts()
    return F.when(text.rlike(r"\A[0-9]*\z"), text).otherwise(
        F.translate(text, source, target)
    )


def strip_whitespace(text: Column) -> Column:
    """Remove leading and trailing white space of any script, information separators included."""
    # the look-behind starts the second branch once per run of white space: linear time
    return F.regexp_replace(
        text, r"(?U)\A[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", ""
    )


def run_name_valid(name: Column) -> Column:
    """F1: non-empty and only letters, digits, dot, dash, underscore; NULL counts as invalid."""
    return F.coalesce(name.rlike(RUN_NAME_PATTERN), F.lit(False))
