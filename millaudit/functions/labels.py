"""Package label fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millaudit import fixed_values as V
from millaudit.functions.text import col, first_match, strip

# Label field patterns, in order of priority.
PRODUCT_TYPE_PATTERNS = [
    r"产品类型[：:\s]*([^，！。\n\r\x{ff0c}\x{ff01}\x{ff0e}]+)",
    r"类型[：:\s]*([^，\n\r\x{ff0c}]+)",
    r"品类[：:\s]*([^\n\r]+)",
    r"产品类别[：:\s]*([^\n\r]+)",
    r"产品种类[：:\s]*([^\n\r]+)",
    r"产品类型[：:\s]*\n\s*([^\n\r]+)",
    r"类型[：:\s]*\n\s*([^\n\r]+)",
]
STANDARD_CODE_LABELS = [r"产品标准[号代]*[：:\s]*", r"执行标准[：:\s]*", r"标准[号代][：:\s]*", r"标准编号[：:\s]*"]


def product_type(c) -> Column:
    """First product type of at least two characters."""

    def cleaned(pattern):
        value = strip(F.regexp_replace(strip(first_match(c, pattern, 1)), "^[:：]+", ""))
        value = F.regexp_replace(value, r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9个分]+$", "")
        return F.when(F.length(value) >= 2, value)

    return F.coalesce(*[cleaned(p) for p in PRODUCT_TYPE_PATTERNS])


def standard_code(c) -> Column:
    """Standard code of a label: after a label word, else anywhere; upper case, one space."""
    code = f"({V.GB_LABEL})"
    labelled = [first_match(c, "(?i)" + label + code, 1) for label in STANDARD_CODE_LABELS]
    anywhere = first_match(c, r"(?iU)\b" + code + r"\b", 1)
    spaced = F.upper(strip(F.regexp_replace(F.coalesce(*labelled, anywhere), r"[\s.]+", " ")))
    return F.regexp_replace(spaced, r"^(GB(?:/T)?)(\d)", "$1 $2")


def shelf_life(c) -> Column:
    """Number and unit of the shelf life, else its whole text."""
    text = strip(first_match(col(c), r"保质期[：:]\s*([^\n\r]+)", 1))
    return F.coalesce(first_match(text, r"(\d+\s*[个]?[月天年])", 1), text)
