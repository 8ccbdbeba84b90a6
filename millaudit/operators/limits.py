"""Measured values against limits, and limits out of rule texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millaudit import fixed_values as V
from millaudit.functions import html, numbers as N
from millaudit.functions.text import (
    all_matches, col, first_match, name_without_notes, name_without_unit_note, number_text, strip,
)


def limit_decisions(rows: DataFrame, value: str = "value", limit: str = "limit", report_limit: str = "report_limit") -> DataFrame:
    """Adds limit_issue (message, null = fine or undecidable) and limit_rule (the rule that decided).

    Order: sampling plan of the limit (else of the report's limit), undecided sample lists, forbidden,
    range, maximum, minimum.
    """
    v, text = F.col("_v"), F.coalesce(F.col(value), F.lit(""))
    plan, samples, lim = F.col("_plan"), F.col("_samples"), F.col("_lim")
    staged = rows.select(
        "*",
        F.coalesce(N.sampling_plan(limit), N.sampling_plan(report_limit)).alias("_plan"),
        N.sample_values(value).alias("_samples"),
        N.measured_value(value).alias("_v"),
        N.limit_bounds(limit).alias("_lim"),
    )
    given = (F.coalesce(F.col(value), F.lit("")) != "") & (F.coalesce(F.col(limit), F.lit("")) != "")

    def outcome(rule, message):
        return F.struct(F.lit(rule).alias("rule"), message.cast("string").alias("message"))

    def below(bound):
        return F.concat(F.lit("低于最小值 (实测 "), text, F.lit(" < "), number_text(bound), F.lit(")"))

    single = F.when(
        v > plan["high"],
        F.concat(F.lit("不合格：实测值 "), number_text(v), F.lit(" 超出M值上限 "), number_text(plan["high"])),
    ).when(
        v > plan["low"],
        F.concat(
            F.lit("警告：实测值 "), number_text(v), F.lit(" 介于m~M之间 (m="), number_text(plan["low"]), F.lit(", M="),
            number_text(plan["high"]), F.lit(")，需结合完整采样数据判定"),
        ),
    )
    decided = (
        F.when(~given, outcome("none", F.lit(None)))
        .when(plan.isNotNull() & samples.isNotNull(), outcome("plan", N.plan_message(samples, plan)))
        .when(plan.isNotNull(), outcome("plan_single", single))
        .when(samples.isNotNull() | v.isNull(), outcome("undecided", F.lit(None)))
        .when(
            lim["kind"] == "forbidden",
            outcome("forbidden", F.when(v > 0, F.concat(F.lit("要求不得检出，实际检出 "), text))),
        )
        .when(
            lim["kind"] == "range",
            outcome(
                "range",
                F.when(v < lim["lo"], below(lim["lo"])).when(
                    v > lim["hi"],
                    F.concat(F.lit("超出最大值 (实测 "), text, F.lit(" > "), number_text(lim["hi"]), F.lit(")")),
                ),
            ),
        )
        .when(
            lim["kind"] == "max",
            outcome(
                "max",
                F.when(
                    v > lim["hi"],
                    F.concat(F.lit("超标 (实测 "), text, F.lit(" > 限量 "), number_text(lim["hi"]), F.lit(")")),
                ),
            ),
        )
        .when(lim["kind"] == "min", outcome("min", F.when(v < lim["lo"], below(lim["lo"]))))
        .otherwise(outcome("none", F.lit(None)))
    )
    return (
        staged.withColumn("_d", decided)
        .withColumn("limit_rule", F.col("_d.rule"))
        .withColumn("limit_issue", F.col("_d.message"))
        .drop("_plan", "_samples", "_v", "_lim", "_d")
    )


def review_classes(rows: DataFrame, value: str = "value", reported: str = "report_limit", limit: str = "limit", unit: str = "unit") -> DataFrame:
    """Adds compliance (compliant / inconsistent / unknown) and row_class of the review.

    row_class: compliant, exceeded, standard_mismatch, missing_standard or missing_unit.
    """
    m, lim, rep = F.col("_m"), F.col("_lim"), F.col("_rep")
    plan, samples, single = F.col("_plan"), F.col("_samples"), F.col("_single")
    staged = rows.select(
        "*",
        F.coalesce(N.review_plan(reported), N.review_plan(limit)).alias("_plan"),
        N.review_samples(value).alias("_samples"),
        N.review_number(value).alias("_m"),
        N.review_range(limit).alias("_lim"),
        N.review_range(reported).alias("_rep"),
        N.leading_number(F.translate(N.half_width_signs(value), "<＜", "")).alias("_single"),
        N.leading_number(F.regexp_replace(N.half_width_signs(limit), "[^0-9.]", "")).alias("_bare"),
        N.is_found(limit).alias("_found"),
        N.is_found(reported).alias("_rep_found"),
        (F.coalesce(strip(value), F.lit("")).isin("", "–") == F.lit(False)).alias("_measured"),
    )
    inside = (lim["lo"].isNull() | (m >= lim["lo"])) & (lim["hi"].isNull() | (m <= lim["hi"]))
    yes, no, open_ = F.lit("compliant"), F.lit("inconsistent"), F.lit("unknown")
    either = lambda c: F.when(c, yes).otherwise(no)
    rep_form = N.half_width_signs(F.coalesce(F.col(reported), F.lit("")))
    bare_form = lambda c: F.regexp_replace(N.half_width_signs(c), "^[≤<≥>]", "")
    by_plan = (
        F.when(plan.isNotNull() & F.col("_measured") & samples.isNotNull(), N.review_plan_class(samples, plan))
        .when(
            plan.isNotNull() & F.col("_measured") & single.isNotNull(),
            F.when(plan["high"].isNull(), either(single <= plan["low"]))
            .when(single > plan["high"], no)
            .when(single > plan["low"], open_)
            .otherwise(yes),
        )
    )
    bare_rule = F.when(
        F.col("_measured") & m.isNotNull() & lim.isNull() & F.col("_bare").isNotNull(),
        F.when(F.abs(m - F.col("_bare")) < 1e-9, yes)
        .when(F.col("_rep_found") & rep_form.rlike("^[≥>]"), either(m >= F.col("_bare")))
        .when(F.col("_rep_found") & rep_form.rlike("^[≤<]"), either(m <= F.col("_bare"))),
    )
    by_report = F.when(
        F.col("_rep_found"),
        F.when(
            rep.isNotNull() & lim.isNotNull(),
            either(lim["hi"].isNull() | rep["hi"].isNull() | (rep["hi"] <= lim["hi"])),
        )
        .when(bare_form(F.col(reported)) == bare_form(F.col(limit)), yes)
        .otherwise(open_),
    )
    in_range = F.when(F.col("_measured") & m.isNotNull() & lim.isNotNull(), either(inside))
    compliance = F.coalesce(
        by_plan, F.when(~F.col("_found"), open_), in_range, bare_rule, by_report, open_
    )
    unit_known = ~F.coalesce(strip(unit), F.lit("")).isin("", "–")
    row_class = (
        F.when(~F.col("_found"), "missing_standard")
        .when(lim.isNotNull() & m.isNotNull(), F.when(inside, "compliant").otherwise("exceeded"))
        .when(F.col("compliance") == "compliant", "compliant")
        .when(F.col("compliance") == "inconsistent", "standard_mismatch")
        .when(unit_known, "missing_standard")
        .otherwise("missing_unit")
    )
    return (
        staged.withColumn("compliance", compliance)
        .withColumn("row_class", row_class)
        .drop("_plan", "_samples", "_m", "_lim", "_rep", "_single", "_bare", "_found", "_rep_found", "_measured")
    )


def sampling_verdicts(rows: DataFrame, value: str = "value", plan: str = "plan") -> DataFrame:
    """Sampling plans over sample lists, back-office and review variants side by side."""
    staged = rows.select(
        "*", N.sample_values(value).alias("_s"), N.sampling_plan(plan).alias("_p"),
        N.review_samples(value).alias("_rs"), N.review_plan(plan).alias("_rp"),
    )
    both = F.col("_s").isNotNull() & F.col("_p").isNotNull()
    review = F.col("_rs").isNotNull() & F.col("_rp").isNotNull()
    return (
        staged.withColumn("passes", F.when(both, N.plan_message(F.col("_s"), F.col("_p")).isNull()))
        .withColumn("review_class", F.when(review, N.review_plan_class(F.col("_rs"), F.col("_rp"))))
        .drop("_s", "_p", "_rs", "_rp")
    )


# --- limits out of tables -----------------------------------------------------------------------

def _header_at(headers: Column, test) -> Column:
    at = F.array_position(F.transform(headers, test), F.lit(True)).cast("int")
    return F.when(at > 0, at)


def _cell(cells: Column, at: Column) -> Column:
    return F.coalesce(F.get(cells, at - 1), F.lit(""))


def _any_word(words):
    return lambda h: reduce(lambda a, b: a | b, [F.contains(h, F.lit(w)) for w in words])


def limits_by_food(rows: DataFrame) -> DataFrame:
    """Limit standards: rows has content, item and categories (ordered array).

    The table right behind the item name counts (the whole text when there is none); the first row whose
    food column holds a category and has a real value wins, categories in order inside a row.
    """
    text = F.col("content")
    core = name_without_unit_note("item")

    def table_after(name):
        at = F.instr(text, name)
        begin = F.position(F.lit("<table"), F.lower(text), at)
        stop = F.position(F.lit("</table>"), F.lower(text), F.greatest(begin, F.lit(1)))
        return F.when((name != "") & (at > 0) & (begin > 0) & (stop > 0), F.substring(text, begin, stop + 8 - begin))

    narrowed = F.coalesce(table_after(F.col("item")), table_after(core), text)
    staged = rows.withColumn("_rows", html.data_rows(narrowed)).withColumn(
        "_headers", F.get(F.col("_rows"), F.lit(0))["headers"]
    )
    food_at = F.coalesce(_header_at(F.col("_headers"), _any_word(["食品", "饲料", "品种", "名称"])), F.lit(1))
    limit_at = _header_at(F.col("_headers"), lambda h: F.contains(h, F.lit("限量")))
    staged = staged.withColumn("_food_at", food_at).withColumn("_limit_at", limit_at)

    def usable(row):
        value = strip(_cell(row["cells"], F.col("_limit_at")))
        hit = F.exists("categories", lambda k: (k != "") & F.contains(_cell(row["cells"], F.col("_food_at")), k))
        return hit & F.col("_limit_at").isNotNull() & ~value.isin(V.EMPTY_LIMIT_CELLS)

    hit = F.get(F.filter("_rows", usable), F.lit(0))
    unit = first_match(F.get(F.col("_headers"), F.col("_limit_at") - 1), "[（(]([^）)]{1,30})[）)]", 1)
    parsed = F.size("_rows") > 0
    return (
        staged.withColumn(
            "standard_unit",
            F.when(parsed, F.coalesce(strip(unit), F.lit("mg/kg"))).otherwise(F.lit(V.NOT_FOUND_UNIT)),
        )
        .withColumn(
            "standard_value",
            F.coalesce(strip(F.get(hit["cells"], F.col("_limit_at") - 1)), F.lit(V.NOT_FOUND_VALUE)),
        )
        .drop("_rows", "_headers", "_food_at", "_limit_at")
    )


def limits_by_item(rows: DataFrame) -> DataFrame:
    """Product standards: rows has content and item. The first row whose name cell matches the item gives
    the unit (unit column, title brackets or value text) and the first two values."""
    staged = rows.withColumn("_rows", html.data_rows("content")).withColumn(
        "_headers", F.get(F.col("_rows"), F.lit(0))["headers"]
    )
    headers = F.col("_headers")
    unit_at = _header_at(headers, lambda h: h.rlike("(?i)单位|unit"))
    name_at = F.coalesce(_header_at(headers, lambda h: h.rlike("项目|营养|成分|名称")), F.lit(1))
    bracket = lambda h: F.regexp_extract(h, "[（(]([^）)]{1,25})[）)]", 1)
    header_unit = F.get(
        F.filter(F.transform(headers, bracket), lambda u: u.rlike(r"[/\x{3bc}\x{b5}%]|mg|g|ug|kJ|CFU")), F.lit(0)
    )
    staged = (
        staged.withColumn("_unit_at", unit_at)
        .withColumn("_name_at", name_at)
        .withColumn("_header_unit", F.when(unit_at.isNull(), strip(header_unit)))
        .withColumn("_clean", name_without_notes("item"))
    )

    def matches(row):
        own = _cell(row["cells"], F.col("_name_at"))
        cell = F.when(own != "", own).otherwise(_cell(row["cells"], F.lit(1)))
        clean = name_without_notes(cell)
        return (
            (strip(cell) == F.col("item")) | F.contains(cell, F.col("item")) | (clean == F.col("_clean"))
            | ((F.col("_clean") != "") & F.contains(clean, F.col("_clean")))
        )

    staged = staged.withColumn("_hit", F.get(F.filter("_rows", matches), F.lit(0)))
    others = F.filter(
        F.transform(
            F.col("_hit.cells"),
            lambda x, i: F.when(
                (i + 1 != F.col("_name_at")) & (i + 1 != F.coalesce(F.col("_unit_at"), F.lit(0))), strip(x)
            ),
        ),
        lambda x: x.isNotNull() & (x != "") & ~x.isin("-", "—", "/", "——"),
    )
    in_value = r"([μa-zA-Z%/·kJ]{1,20}(?:/[a-zA-Z]+)*)"
    unit_sign = "[/μ%]|mg|g|ug|kJ|CFU"
    known = F.coalesce(
        F.when(F.col("_unit_at").isNotNull(), F.when(_cell(F.col("_hit.cells"), F.col("_unit_at")) != "", strip(_cell(F.col("_hit.cells"), F.col("_unit_at")))).otherwise(F.lit("–"))),
        F.col("_header_unit"), F.lit("–"),
    )
    staged = staged.withColumn("_values", others).withColumn("_unit", known)
    # A value carrying its unit ("0.43 g/100kJ"): the first such value gives the unit and loses it.
    carrier = F.array_position(
        F.transform("_values", lambda x: F.regexp_extract(x, in_value, 1).rlike(unit_sign)), F.lit(True)
    ).cast("int")
    staged = staged.withColumn("_carrier", F.when((F.col("_unit") == "–") & (carrier > 0), carrier))
    found_unit = F.regexp_extract(F.get(F.col("_values"), F.col("_carrier") - 1), in_value, 1)
    values = F.filter(
        F.transform(
            "_values",
            lambda x, i: F.when(i + 1 == F.col("_carrier"), strip(F.regexp_replace(x, "(?s)" + in_value + ".*$", ""))).otherwise(x),
        ),
        lambda x: x != "",
    )
    hit = F.col("_hit").isNotNull()
    return (
        staged.withColumn(
            "standard_unit",
            F.when(hit, F.coalesce(strip(found_unit), F.col("_unit"))).otherwise(F.lit(V.NOT_FOUND_UNIT)),
        )
        .withColumn(
            "standard_value",
            F.when(hit & (F.size(values) > 0), F.array_join(F.slice(values, 1, 2), " ~ ")).otherwise(F.lit(V.NOT_FOUND_VALUE)),
        )
        .drop("_rows", "_headers", "_unit_at", "_name_at", "_header_unit", "_clean", "_hit", "_values", "_unit", "_carrier")
    )


def limit_fields(rows: DataFrame) -> DataFrame:
    """Limit unit and value of a text: by food for limit standards, by item for product standards, else from text.

    rows: content, item, categories, query_code.
    """
    is_limit = F.regexp_replace("query_code", r"\D", "").rlike("^276[123]")
    has_html = F.lower("content").rlike("<table|<td")
    keep = rows.columns
    marked = rows.withColumn("_limit", is_limit).withColumn("_html", has_html)
    food = limits_by_food(marked.where(F.col("_html") & F.col("_limit")))
    item = limits_by_item(marked.where(F.col("_html") & ~F.col("_limit")))
    plain = marked.where(~F.col("_html")).withColumn("_t", N.text_limit("content"))
    plain = plain.withColumn("standard_unit", F.col("_t.unit")).withColumn("standard_value", F.col("_t.value"))
    wanted = [*keep, "standard_unit", "standard_value"]
    return food.select(wanted).unionByName(item.select(wanted)).unionByName(plain.select(wanted))


def limit_text_by_food(rows: DataFrame) -> DataFrame:
    """Limit as one text, by three levels: food row of a table, any cell of a row, running text.

    rows: content, categories. The first level that finds something wins.
    """
    staged = rows.withColumn("_rows", html.data_rows("content"))
    staged = staged.withColumn("_headers", F.get(F.col("_rows"), F.lit(0))["headers"])
    headers = F.col("_headers")
    food_at = F.coalesce(_header_at(headers, _any_word(["食品", "饲料", "品种", "作物", "名称"])), F.lit(1))
    last_limit = F.array_max(F.transform(headers, lambda h, i: F.when(F.contains(h, F.lit("限量")), i + 1)))
    title_unit = F.try_element_at(
        F.filter(
            F.transform(headers, lambda h: F.when(F.contains(h, F.lit("限量")), first_match(h, "[（(]([^）)]+)[）)]", 1))),
            lambda u: u.isNotNull(),
        ),
        F.lit(-1),
    )
    staged = (
        staged.withColumn("_food_at", food_at)
        .withColumn("_limit_at", last_limit)
        .withColumn("_unit", F.coalesce(strip(title_unit), F.lit("mg/kg")))
    )
    names = lambda text: F.exists("categories", lambda k: (k != "") & F.contains(text, k))
    value = lambda r: strip(_cell(r["cells"], F.col("_limit_at")))
    by_cell = F.get(
        F.filter(
            "_rows",
            lambda r: names(_cell(r["cells"], F.col("_food_at"))) & F.col("_limit_at").isNotNull() & ~value(r).isin(V.EMPTY_LIMIT_CELLS),
        ),
        F.lit(0),
    )
    joined = F.filter(
        F.transform("_rows", lambda r: F.array_join(r["cells"], " ")), lambda t: names(t) & t.rlike(r"\d")
    )
    by_row = F.regexp_extract(F.get(joined, F.lit(0)), r"(\d+\.?\d*)", 1)
    lines = F.split("content", "\n")
    line_unit = first_match(
        F.get(F.filter(lines, lambda t: t.rlike("最大残留限量|最大限量") & t.rlike("[（(][^）)]+[）)]")), F.lit(0)),
        "[（(]([^）)]+)[）)]", 1,
    )
    food_line = F.get(
        F.filter(
            F.transform(
                "categories", lambda k: F.get(F.filter(lines, lambda t: (k != "") & F.contains(t, k)), F.lit(0))
            ),
            lambda t: t.isNotNull(),
        ),
        F.lit(0),
    )
    signed = r"([≤<]?\s*\d+\.?\d*)\s*(mg/kg|ppm|%|μg/kg|mg/L)?"
    sign_value, sign_unit = strip(F.regexp_extract(food_line, signed, 1)), F.regexp_extract(food_line, signed, 2)
    bare = strip(F.regexp_replace(sign_value, "^[≤<]+", ""))
    shown = F.concat(F.when(sign_value.rlike("^[≤<]"), F.lit("≤")).otherwise(F.lit("")), bare)
    in_line = F.when(
        food_line.isNotNull() & (sign_value != ""),
        F.concat_ws(" ", shown, F.when(sign_unit != "", sign_unit).otherwise(F.coalesce(strip(line_unit), F.lit("mg/kg")))),
    )
    anywhere = r"(\d+\.?\d*)\s*(mg/kg|ppm|%|μg/kg)"
    in_text = F.when(
        food_line.isNull(),
        F.when(
            F.col("content").rlike(anywhere),
            F.concat_ws(" ", F.regexp_extract("content", anywhere, 1), F.regexp_extract("content", anywhere, 2)),
        ).otherwise(F.lit("未找到限量值")),
    )
    return staged.withColumn(
        "limit_text",
        F.coalesce(
            F.when(by_cell.isNotNull(), F.concat_ws(" ", value(by_cell), F.col("_unit"))),
            F.when(by_row != "", F.concat_ws(" ", by_row, F.col("_unit"))),
            in_line, in_text,
        ),
    ).drop("_rows", "_headers", "_food_at", "_limit_at", "_unit")


def numbers_in(c) -> Column:
    return all_matches(c, r"\d+\.?\d*")


def checked_limits(rows: DataFrame) -> DataFrame:
    """Rejects insane limits and adds the display text; rows: standard_value, standard_unit, number_key."""
    return (
        rows.withColumn("_s", N.sane_limit("standard_value", "standard_unit", "number_key"))
        .withColumn("standard_value", F.col("_s.value"))
        .withColumn("standard_unit", F.col("_s.unit"))
        .withColumn("extracted_limit", N.limit_text("standard_value", "standard_unit"))
        .drop("_s")
    )


def corrected_pages(evidence: DataFrame, code: str = "gb_code") -> DataFrame:
    """Page of known items of one standard replaced by its fixed page."""
    pairs = [x for item, page in V.PAGE_BY_ITEM_2763.items() for x in (F.lit(item), F.lit(page))]
    fixed = F.try_element_at(F.create_map(*pairs), F.col("item"))
    return evidence.withColumn(
        "page_num", F.when(F.contains(col(code), F.lit("2763")), F.coalesce(fixed, F.col("page_num"))).otherwise(F.col("page_num"))
    )
