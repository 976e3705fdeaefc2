"""Text forms as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: everything that is neither a letter nor a number
NOT_LN = r"[^\p{L}\p{N}]+"


def bare(c: Column | str) -> Column:
    """Bare form: lower-cased letters and numbers in order, all else left out. Null stays null, '' stays ''."""
    return F.regexp_replace(F.lower(c), NOT_LN, "")


def has_letter(bare_form: Column | str) -> Column:
    """True if a bare form holds at least one letter; null counts as false."""
    return F.coalesce(F.col(bare_form) if isinstance(bare_form, str) else bare_form, F.lit("")).rlike(r"\p{L}")
