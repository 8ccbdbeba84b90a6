"""Standard codes: extraction, numbers, method comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millaudit import fixed_values as V
from millaudit.functions.text import BLANK, all_matches, col, contains_any, squash, strip, without_blanks


def report_codes(c) -> Column:
    """Cited codes of a text in order; runs of blanks count as one."""
    flat = F.regexp_replace(col(c), f"{BLANK}+", " ")
    return F.transform(all_matches(flat, V.GB_REPORT), strip)


def method_codes(c) -> Column:
    """Method codes with a four-digit year."""
    return F.transform(all_matches(c, V.GB_METHOD_WITH_YEAR), squash)


def consistency_codes(c) -> Column:
    return F.transform(all_matches(c, "(?i)" + V.GB_CONSISTENCY), squash)


def split_method_codes(c) -> Column:
    return all_matches(c, V.GB_SPLIT_METHODS)


def standard_number(c) -> Column:
    """Number with year: prefix off, no blanks round the hyphen."""
    bare = F.regexp_replace(strip(c), r"(?i)^(?:GB/T|GB|GBT)\s*", "")
    return strip(F.regexp_replace(bare, r"\s*-\s*", "-"))


def standard_number_short(c) -> Column:
    """Older rule: the first digits-year part, else the text without the prefix."""
    c = col(c)
    tail = F.regexp_extract(c, r"(\d+-\d{4})", 1)
    bare = strip(F.regexp_replace(F.regexp_replace(c, "GB", ""), "gb", ""))
    return F.when(tail != "", tail).otherwise(bare)


def number_key(c) -> Column:
    """First number of a code, used to find its document; the text itself when it has none."""
    c = col(c)
    key = F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1)
    return F.when(key != "", key).otherwise(c)


def without_trailing_year(c) -> Column:
    return strip(F.regexp_replace(strip(c), r"-\s*\d{4}$", ""))


def has_trailing_year(c) -> Column:
    return col(c).rlike(r"-\d{4}$")


def method_form(c) -> Column:
    """Lower case, no year, no blanks."""
    return F.lower(without_blanks(F.regexp_replace(col(c), r"\s*[-—–]\s*\d{4}", "")))


def method_matches(reported, required) -> Column:
    """Does the reported method (or cited code) satisfy the required text?

    Every code of the requirement owns the ordinals up to the next code; one satisfied code is enough.
    """
    reported, required = col(reported), col(required)
    code = "(?i)" + V.GB_METHOD_COMPARE
    ordinal = "(?i)" + V.METHOD_ORDINAL
    segment = r"(?is)(GB(?:/T|/Z)?\s*\d[\d.]*)((?:(?!GB(?:/T|/Z)?\s*\d).)*)"
    rep_form, req_form = method_form(reported), method_form(required)
    rep_codes = F.transform(all_matches(reported, code), method_form)
    rep_ordinals = F.transform(all_matches(reported, ordinal), method_form)
    pairs = F.arrays_zip(
        all_matches(required, segment, 1).alias("code"), all_matches(required, segment, 2).alias("tail")
    )

    def satisfied(pair):
        need = method_form(pair["code"])
        hit = F.exists(rep_codes, lambda g: F.contains(g, need) | F.contains(need, g))
        ordinals = F.transform(all_matches(pair["tail"], ordinal), method_form)
        return hit & ((F.size(ordinals) == 0) | F.arrays_overlap(ordinals, rep_ordinals))

    return (
        F.when(rep_form == req_form, F.lit(True))
        .when(~required.rlike(code), F.contains(rep_form, req_form) | F.contains(req_form, rep_form))
        .otherwise(F.exists(pairs, satisfied))
    )


def required_method_tokens(c) -> Column:
    """Required methods as tokens: a Latin prefix takes the next word, and an ordinal after that."""
    token = r"(?<!\S)(?:[A-Za-z]+(?:/[A-Za-z]+)?\s+\S+(?:\s+第[一二三四五六七八九十百\d]\S*)?|\S+)"
    return F.transform(all_matches(strip(c), token), squash)


def basis_exempt(c) -> Column:
    """Declared or company standards cannot be checked against cited codes."""
    return contains_any(c, ["明示", "企业标准"])


def query_code(required_basis, first_code, residue_code=None, prefer_residue: bool = False) -> Column:
    """Code to look limits up with: the required basis if it has a digit, else the first cited code.

    ``prefer_residue`` switches to the first cited pesticide standard, which the default overrides.
    """
    basis = strip(F.coalesce(col(required_basis), F.lit("")))
    fallback = F.coalesce(col(residue_code), col(first_code)) if prefer_residue else col(first_code)
    return F.when(basis.rlike(r"\d"), basis).otherwise(F.coalesce(fallback, F.when(basis != "", basis), F.lit("")))
