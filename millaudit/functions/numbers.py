"""Measured values, sampling plans, ranges and limit decisions (back-office and review variants)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from millaudit import fixed_values as V
from millaudit.functions.text import all_matches, col, contains_any, half_width, half_width_signs, let, number, number_text, strip

_PLAN_N = r"(?U)\bn\s*=\s*(\d+)"
_PLAN_C = r"(?U)\bc\s*=\s*(\d+)"
_PLAN_LOW = r"(?U)(?<![nNcC])\bm\s*=\s*([\d.]+)"
_PLAN_HIGH = r"(?U)\bM\s*=\s*([\d.]+)"
_RANGE = r"(?U)([≥>]?\d+\.?\d*)\s*[~～\-–—]\s*([≤<]?\d+\.?\d*)"
_JS_NUMBER = r"^(\d+\.?\d*|\.\d+)"


def _number_in(c, pattern: str) -> Column:
    return number(F.regexp_extract(col(c), pattern, 1))


def leading_number(c) -> Column:
    """Number a text starts with, the rest ignored."""
    return let(F.regexp_extract(col(c), _JS_NUMBER, 1), lambda v: F.when(v != "", v.try_cast("double")))


def measured_value(c) -> Column:
    """Measured value: not detected and '<' count as 0, else the first number."""
    return let(
        strip(c),
        lambda v: F.when(v.isNull() | (v == ""), F.lit(None).cast("double"))
        .when(F.contains(v, F.lit("未检出")) | F.contains(F.upper(v), F.lit("ND")) | v.startswith("<"), F.lit(0.0))
        .otherwise(_number_in(v, r"(?U)([\d.]+)")),
    )


def sampling_plan(c) -> Column:
    """n/c/m/M plan; null unless all four are given."""
    c = col(c)
    plan = F.struct(
        half_width(F.regexp_extract(c, _PLAN_N, 1)).try_cast("int").alias("n"),
        half_width(F.regexp_extract(c, _PLAN_C, 1)).try_cast("int").alias("c"),
        _number_in(c, _PLAN_LOW).alias("low"),
        _number_in(c, _PLAN_HIGH).alias("high"),
    )

    def complete(p):
        return F.when(p["n"].isNotNull() & p["c"].isNotNull() & p["low"].isNotNull() & p["high"].isNotNull(), p)

    return F.when(F.contains(c, F.lit("=")), let(plan, complete))


def sample_values(c) -> Column:
    """Values of several samples, null for a single value or an unreadable part."""
    c = col(c)

    def value(p):
        zero = p.rlike(r"(?U)^[<＜]\s*[\d.]") | F.contains(p, F.lit("未检出")) | p.rlike("(?i)^ND$")
        return F.when(zero, F.lit(0.0)).otherwise(_number_in(p, r"(?U)([\d.]+)"))

    parts = F.filter(F.transform(F.split(strip(c), "[,，、；;]+"), strip), lambda p: p != "")
    values = let(
        F.transform(parts, value),
        lambda v: F.when((F.size(v) >= 2) & F.forall(v, lambda x: x.isNotNull()), v),
    )
    return F.when(c.rlike("[,，、；;]"), values)


def over_low(samples: Column, plan: Column) -> Column:
    """Samples above m, up to M."""
    return F.size(F.filter(samples, lambda v: (v > plan["low"]) & (v <= plan["high"])))


def plan_message(samples: Column, plan: Column) -> Column:
    """Message of a failed sampling plan, null when it passes."""
    above = F.filter(samples, lambda v: v > plan["high"])
    return F.when(
        F.size(above) > 0,
        F.concat(
            F.lit("不合格：样品检出值 "), number_text(F.try_element_at(above, F.lit(1))),
            F.lit(" 超出M值上限 "), number_text(plan["high"]), F.lit(" (M="), number_text(plan["high"]), F.lit(")"),
        ),
    ).when(
        over_low(samples, plan) > plan["c"],
        F.concat(
            F.lit("不合格：介于m~M之间的样品数 "), over_low(samples, plan).cast("string"), F.lit(" 超过允许数 c="),
            plan["c"].cast("string"), F.lit(" (m="), number_text(plan["low"]), F.lit(", M="),
            number_text(plan["high"]), F.lit(")"),
        ),
    )


def limit_bounds(c) -> Column:
    """Limit text as struct(kind, lo, hi): none, forbidden, range, max, min."""
    nothing = F.lit(None).cast("double")
    top, least = r"(?U)(?:≤|<=|<)([\d.]+)", r"(?U)(?:≥|>=|>)([\d.]+)"

    def bounds(kind, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.alias("lo"), b.alias("hi"))

    def bare(flat, group):
        return number(F.regexp_replace(F.regexp_extract(flat, _RANGE, group), r"(?U)[^\d.]", ""))

    def read(flat):
        return (
            F.when(contains_any(flat, ["不得检出", "不得检测出"]), bounds("forbidden", nothing, nothing))
            .when(flat.rlike(_RANGE), bounds("range", bare(flat, 1), bare(flat, 2)))
            .when(flat.rlike(top) & _number_in(flat, top).isNotNull(), bounds("max", nothing, _number_in(flat, top)))
            .when(flat.rlike(least) & _number_in(flat, least).isNotNull(), bounds("min", _number_in(flat, least), nothing))
            .otherwise(bounds("none", nothing, nothing))
        )

    return let(F.translate(strip(c), " 　", ""), read)


# --- review variants ----------------------------------------------------------------------------

def review_number(c) -> Column:
    """Measured value in the review: '<' is only dropped, the largest number counts."""
    raw = col(c)
    nothing = F.lit(None).cast("double")

    def read(flat):
        numbers = F.transform(all_matches(flat, r"[0-9.]+"), leading_number)
        return (
            F.when(F.contains(flat, F.lit("未检出")), F.lit(0.0))
            .when(flat.rlike("[:,，]"), nothing)
            .otherwise(F.array_max(numbers))
        )

    known = raw.isNotNull() & (raw != "") & (raw != "–")
    return F.when(known, let(F.translate(half_width_signs(raw), "＜<", ""), read))


def review_range(c) -> Column:
    """Limit text as struct(lo, hi), null when its meaning is open (ratio, bare number, text)."""
    nothing = F.lit(None).cast("double")

    def side(part):
        is_open = part.rlike(r"(?i)N\.?S\.?") | part.rlike("^[a-zA-Z]")
        numbers = F.transform(all_matches(part, r"[0-9.]+"), leading_number)
        return F.when(~is_open, F.try_element_at(numbers, F.lit(-1)))

    def span(a, b):
        return F.struct(a.alias("lo"), b.alias("hi"))

    def one_sided(flat, sign, place):
        bound = leading_number(F.regexp_extract(flat, f"^[{sign}]([0-9.]+)", 1))
        return F.when(flat.rlike(f"^[{sign}][0-9.]"), span(nothing, bound) if place == "hi" else span(bound, nothing))

    def two_sided(flat):
        parts = F.split(flat, "~")
        both = span(side(F.get(parts, F.lit(0))), side(F.get(parts, F.lit(1))))
        usable = let(both, lambda r: F.when(r["lo"].isNotNull() | r["hi"].isNotNull(), r))
        return F.when(F.contains(flat, F.lit("~")) & (F.size(parts) == 2), usable)

    def read(flat):
        unusable = (flat == "") | flat.rlike(r"^[–\-]$|未查到|未找到|未提取|:")
        return F.when(~unusable, F.coalesce(one_sided(flat, "≤<", "hi"), one_sided(flat, "≥>", "lo"), two_sided(flat)))

    return let(F.translate(half_width_signs(F.coalesce(col(c), F.lit(""))), "％%", ""), read)


def review_plan(c) -> Column:
    """n/c/m plan of the review; M is optional."""
    c = F.coalesce(col(c), F.lit(""))
    edge = r"(?<![A-Za-z0-9_])"
    plan = F.struct(
        F.regexp_extract(c, edge + r"n\s*=\s*(\d+)", 1).try_cast("int").alias("n"),
        F.regexp_extract(c, edge + r"c\s*=\s*(\d+)", 1).try_cast("int").alias("c"),
        leading_number(F.regexp_extract(c, edge + r"m\s*=\s*([\d.]+)", 1)).alias("low"),
        leading_number(F.regexp_extract(c, edge + r"M\s*=\s*([\d.]+)", 1)).alias("high"),
    )
    complete = lambda p: F.when(p["n"].isNotNull() & p["c"].isNotNull() & p["low"].isNotNull(), p)
    return F.when(F.contains(c, F.lit("=")), let(plan, complete))


def review_samples(c) -> Column:
    c = F.coalesce(col(c), F.lit(""))

    def value(p):
        return F.when(p.rlike("(?i)[<＜]|未检出|^ND$"), F.lit(0.0)).otherwise(
            leading_number(F.regexp_extract(p, r"([0-9.]+)", 1))
        )

    parts = F.filter(F.transform(F.split(c, "[,，；;]+"), strip), lambda p: p != "")
    values = let(
        F.transform(parts, value),
        lambda v: F.when((F.size(v) >= 2) & F.forall(v, lambda x: x.isNotNull()), v),
    )
    return F.when(c.rlike("[,，；;]"), values)


def review_plan_class(samples: Column, plan: Column) -> Column:
    """compliant / inconsistent / unknown (sample count differs from n)."""
    any_over_low = F.exists(samples, lambda v: v > plan["low"])
    return (
        F.when(F.size(samples) != plan["n"], F.lit("unknown"))
        .when(plan["high"].isNull(), F.when(any_over_low, F.lit("inconsistent")).otherwise(F.lit("compliant")))
        .when(F.exists(samples, lambda v: v > plan["high"]), F.lit("inconsistent"))
        .when(over_low(samples, plan) > plan["c"], F.lit("inconsistent"))
        .otherwise(F.lit("compliant"))
    )


def is_found(c) -> Column:
    """Limit or unit text that is not one of the not-found tokens."""
    return col(c).isNotNull() & ~strip(c).isin(V.NOT_FOUND_TOKENS)


def unit_class(reported, required) -> Column:
    """match / differs / unknown for two units."""
    known = is_found(required)
    return (
        F.when(~known, F.lit("unknown"))
        .when((col(reported) != "–") & (col(reported) == col(required)), F.lit("match"))
        .otherwise(F.lit("differs"))
    )


# --- limits found in texts ----------------------------------------------------------------------

def limit_text(value, unit) -> Column:
    """Display text of a limit."""
    value, unit = col(value), col(unit)
    return (
        F.when(value == V.NOT_FOUND_VALUE, F.lit(V.NOT_FOUND_VALUE))
        .when((unit != "") & ~unit.isin("–", "-"), F.concat_ws(" ", value, unit))
        .otherwise(value)
    )


def sane_limit(value, unit, number_key) -> Column:
    """struct(value, unit) after rejecting chapter numbers, document numbers and units that are none."""
    value, unit = strip(value), strip(unit)
    half = half_width(value)
    digits = F.regexp_replace(half, r"\D", "")
    chapter = half.rlike(r"^4\.\d*$")
    document = (F.length(digits) >= 4) & (digits == F.regexp_replace(col(number_key), r"\D", ""))
    rejected = chapter | document
    kept_value = F.when(rejected, F.lit(V.NOT_FOUND_VALUE)).otherwise(value)
    kept_unit = F.when(rejected, F.lit(V.NOT_FOUND_UNIT)).otherwise(unit)
    bad_unit = ~kept_unit.isin("–", "-", "", V.NOT_FOUND_VALUE) & (
        ~kept_unit.rlike(V.VALID_UNIT) | kept_unit.rlike(r"(?i)GB\s*\d{4}")
    )
    return F.struct(
        kept_value.alias("value"), F.when(bad_unit, F.lit(V.NOT_FOUND_UNIT)).otherwise(kept_unit).alias("unit")
    )


def text_limit(c) -> Column:
    """struct(unit, value) from running text: first short bracketed unit, first signed number."""
    c = col(c)
    unit = F.regexp_extract(c, r"[（(]([a-zA-Zμ%/·\x{4e00}-\x{9fff}]{1,20})[）)]", 1)
    value = strip(F.regexp_extract(c, r"[≤≥<>]?\s*\d+\.?\d*", 0))
    return F.struct(
        F.when(unit != "", unit).otherwise(F.lit(V.NOT_FOUND_UNIT)).alias("unit"),
        F.when(value != "", value).otherwise(F.lit(V.NOT_FOUND_VALUE)).alias("value"),
    )
