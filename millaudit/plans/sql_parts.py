"""Snippets of checking SQL shared by several queries."""

from __future__ import annotations

from millaudit import fixed_values as V


def measured(v: str) -> str:
    return (
        f"CASE WHEN {v} = '' THEN NULL WHEN contains({v}, '未检出') OR contains(upper({v}), 'ND') THEN 0.0 "
        f"WHEN starts_with({v}, '<') THEN 0.0 ELSE try_cast(regexp_extract({v}, '([0-9.]+)', 1) AS DOUBLE) END"
    )


def plan_part(c: str, letter: str) -> str:
    return f"try_cast(regexp_extract({c}, '(?:^|[^A-Za-z0-9_]){letter}\\s*=\\s*([0-9.]+)', 1) AS DOUBLE)"


def samples(v: str, split: str = "[,，、；;]+") -> str:
    return (
        f"CASE WHEN len(string_split_regex({v}, '{split}')) >= 2 THEN list_transform(string_split_regex({v}, '{split}'), "
        f"lambda p: CASE WHEN regexp_matches(p, '^[<＜]') OR contains(p, '未检出') OR upper(p) = 'ND' THEN 0.0 "
        f"ELSE try_cast(regexp_extract(p, '([0-9.]+)', 1) AS DOUBLE) END) END"
    )


def flexible_date(c: str) -> str:
    """Date of year, month, day with any single separators, nothing after the day."""
    pat = "^\\s*([0-9]{4})[^0-9]([0-9]{1,2})[^0-9]([0-9]{1,2})\\s*$"
    return (
        f"try_cast(regexp_extract({c}, '{pat}', 1) || '-' || lpad(regexp_extract({c}, '{pat}', 2), 2, '0') || '-' || "
        f"lpad(regexp_extract({c}, '{pat}', 3), 2, '0') AS DATE)"
    )


def squeeze(c: str) -> str:
    return f"regexp_replace({c}, '\\s+', '', 'g')"


def name_core(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '(?s)[(（].*$', ''), '\\s+', '', 'g')"


def composite(c: str) -> str:
    return f"regexp_matches({c}, '{V.COMPOSITE_PATTERN}')"


def category_values() -> str:
    """VALUES rows (kw, kw_pos, cats) of the food category table."""
    rows = [f"('{k}', {i}, '{'|'.join(v)}')" for i, (k, v) in enumerate(V.FOOD_CATEGORIES.items())]
    return "(VALUES " + ", ".join(rows) + ") AS k(kw, kw_pos, cats)"


def standard_number(c: str) -> str:
    return f"regexp_replace(regexp_replace(trim({c}), '^(GB/T|GB|GBT)\\s*', '', 'i'), '\\s*-\\s*', '-', 'g')"


def base_code(c: str) -> str:
    return f"trim(regexp_replace(trim({c}), '-\\s*[0-9]{{4}}$', ''))"
