"""Date texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millaudit import fixed_values as V
from millaudit.functions.text import col, first_match, strip

_FLEXIBLE = r"^\s*(\d{4})\D(\d{1,2})\D(\d{1,2})\s*$"
_WITH_DAY_SIGN = r"^\s*(\d{4})\D(\d{1,2})\D(\d{1,2})日?\s*$"


def date_text(c) -> Column:
    """First date-like text."""
    return first_match(c, V.DATE_IN_TEXT)


def flexible_date(c, strict: bool = True) -> Column:
    """Year, month, day with any single separators, null where unreadable.

    Strict (the default) refuses anything after the day, so a trailing 日 is unreadable.
    """
    c = col(c)
    pattern = _FLEXIBLE if strict else _WITH_DAY_SIGN
    iso = F.concat_ws(
        "-",
        F.regexp_extract(c, pattern, 1),
        F.lpad(F.regexp_extract(c, pattern, 2), 2, "0"),
        F.lpad(F.regexp_extract(c, pattern, 3), 2, "0"),
    )
    return F.when(c.rlike(pattern), F.try_to_date(iso, "yyyy-MM-dd"))


def label_date(c) -> Column:
    """Production date of a package label: 年/月 become hyphens, eight digits stay."""
    c = col(c)
    spaced = first_match(c, r"生产日期[：:]\s*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2})", 1)
    solid = first_match(c, r"生产日期[：:]\s*(\d{8})", 1)
    return F.regexp_replace(F.coalesce(spaced, solid), "[年月]", "-")


def is_blank(c) -> Column:
    return col(c).isNull() | (strip(c) == "")
