"""Text columns: trimming, names, contact data, amounts, dates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Date layouts tried in this order when no layout is given.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
)


_ISO = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}(:?\d{2})?)?$"


def strip(c: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def simple_name(name: str) -> str:
    """Lower case, spaces to underscores, only a-z, 0-9 and underscore."""
    return re.sub(r"[^a-z0-9_]", "", name.strip().lower().replace(" ", "_"))


def standard_name(name: str, keep_case: bool = False) -> str:
    """Runs of white space or underscores become one underscore, other marks go."""
    text = name.strip() if keep_case else name.strip().lower()
    text = re.sub(r"[^\w\s]", "", re.sub(r"\s+", "_", text))
    return re.sub(r"_+", "_", text).strip("_")


def _shape(layout: str) -> str:
    """Regular expression of the texts a layout can fit: every letter stands for one digit."""
    return "^" + re.sub("[a-zA-Z]", r"\\d", re.sub(r"[./]", r"[\g<0>]", layout)) + "$"


def parse_date(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Timestamp by the first layout that fits, else null.

    A text is parsed only by layouts of its own shape; failing parses are slow. Without given layouts,
    ISO 8601 texts (with T or a blank, minutes, seconds, fractions, a zone) and month/day/year with single
    digits are read too.
    """
    known = [F.when(c.rlike(_shape(f)), F.try_to_timestamp(c, F.lit(f))) for f in formats]
    if tuple(formats) == DATE_FORMATS:
        known.append(F.when(c.rlike(_ISO), c.try_cast("timestamp")))
        known.append(F.when(c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(c, F.lit("M/d/yyyy"))))
    return F.coalesce(*known)


def parse_currency(c: Column, symbol: str = "$") -> Column:
    """Amount without currency sign and thousands separators, else null."""
    plain = F.replace(F.replace(c, F.lit(symbol), F.lit("")), F.lit(","), F.lit(""))
    return F.trim(plain).try_cast("double")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def clean_email(c: Column) -> Column:
    return F.lower(F.trim(c))
