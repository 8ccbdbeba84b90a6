"""Report lines and tables: flat views and the fields found by position.

A page is one row (its lines and tables are arrays), so look-ahead windows and first matches inside a
page are array expressions; only one small candidate per page is shuffled, and that is pre-aggregated.
A report of any number of pages never gathers in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millaudit import fixed_values as V
from millaudit.functions import codes, dates
from millaudit.functions.text import col, contains_any, first_match, let, repaired_cell, strip

ITEM_FIELDS = ["index", "item", "unit", "standard", "value", "method", "conclusion"]


def page_lines(lines="text_lines") -> Column:
    return F.filter(F.transform(col(lines), strip), lambda x: x != "")


def report_lines(pages: DataFrame) -> DataFrame:
    """Non-empty stripped lines in (page, line) order."""
    return pages.select("report_id", "page", F.posexplode(page_lines()).alias("line_no", "line"))


def report_cells(pages: DataFrame) -> DataFrame:
    """Cells of all non-empty tables, one row per cell."""
    return (
        pages.select("report_id", "page", F.posexplode("tables").alias("table_no", "rows"))
        .where(F.size("rows") > 0)
        .select("report_id", "page", "table_no", F.posexplode("rows").alias("row_no", "cells"))
        .select("report_id", "page", "table_no", "row_no", F.posexplode("cells").alias("col_no", "cell"))
    )


# --- fields by priority -------------------------------------------------------------------------

def valid_food_name(c) -> Column:
    """Does a value look like a food name?"""
    c = F.coalesce(col(c), F.lit(""))
    clean = strip(c)
    word = F.regexp_extract(clean, r"^[\x{4e00}-\x{9fa5}a-zA-Z]+", 0)
    first_word = F.when(word != "", word).otherwise(F.substring(clean, 1, 4))
    return (
        (F.length(c) >= 2)
        & ~clean.rlike(r"[\n\r]")
        & ~F.contains(clean, F.lit("日期"))
        & ~first_word.isin(V.INVALID_NAME_WORDS)
        & (F.length(clean) <= 50)
        & ~clean.rlike(r"(?U)^[\d\s]+$")
        & ~clean.rlike(r"(?U)^[A-Za-z\s]+$")
    )


def until_next_label(c) -> Column:
    """Value cut at the next field label; a bracket left open at the cut goes too."""
    c = col(c)
    labels = "|".join(V.NEXT_FIELD_LABELS)
    cut = F.rtrim(strip(F.regexp_replace(c, f"(?s)(?:{labels}).*$", "")), F.lit("（("))
    value = F.when(c.rlike(labels), cut).otherwise(c)
    return strip(F.substring_index(value, "\n", 1))


def _column_of(table: Column, words) -> Column:
    """0-based first column whose title holds one of the words, null if none."""
    titles = F.get(table, F.lit(0))
    at = F.array_position(F.transform(titles, lambda t: contains_any(F.coalesce(t, F.lit("None")), words)), F.lit(True))
    return F.when(at > 0, at.cast("int") - 1)


def _first_of_lines(level: int, value_of) -> Column:
    found = F.filter(
        F.transform(
            F.col("lines"),
            lambda line, i: F.struct(
                F.lit(level).alias("level"), F.col("page").cast("long").alias("page"), F.lit(0).alias("table_no"),
                i.alias("at"), value_of(line).alias("value"),
            ),
        ),
        lambda x: x["value"].isNotNull(),
    )
    return F.get(found, F.lit(0))


def _first_of_tables(level: int, words, value_of) -> Column:
    def of_column(table, table_no, at):
        return F.filter(
            F.transform(
                F.slice(table, 2, F.greatest(F.size(table), F.lit(1))),
                lambda row, i: F.struct(
                    F.lit(level).alias("level"), F.col("page").cast("long").alias("page"), table_no.alias("table_no"),
                    i.alias("at"), value_of(F.get(row, at)).alias("value"),
                ),
            ),
            lambda x: x["value"].isNotNull(),
        )

    def of_table(table, table_no):
        return let(_column_of(table, words), lambda at: of_column(table, table_no, at))

    usable = F.filter(F.coalesce(F.col("tables"), F.array().cast("array<array<array<string>>>")), lambda t: F.size(t) > 0)
    return F.get(F.flatten(F.transform(usable, of_table)), F.lit(0))


def first_by_priority(pages: DataFrame, name: str, levels) -> DataFrame:
    """One value per report: lowest level, then page, then position. Each page sends one candidate."""
    best = F.least(*levels) if len(levels) > 1 else levels[0]
    return (
        pages.withColumn("lines", page_lines())
        .select("report_id", best.alias("best"))
        .groupBy("report_id")
        .agg(F.min("best").alias("best"))
        .select("report_id", F.col("best.value").alias(name), F.col("best.level").alias("level"))
    )


def production_dates(pages: DataFrame, keywords=V.DATE_KEYWORDS, pattern: str = V.DATE_IN_TEXT) -> DataFrame:
    """Production date text: keyword line, table column, any line."""
    day = lambda c: first_match(c, pattern)
    return first_by_priority(
        pages, "production_date",
        [
            _first_of_lines(1, lambda x: F.when(contains_any(x, keywords), day(x))),
            _first_of_tables(2, keywords, day),
            _first_of_lines(3, day),
        ],
    )


def food_names(pages: DataFrame, keywords=V.NAME_KEYWORDS) -> DataFrame:
    """Food name: after the colon or the keyword of a line, else a table column; the first valid one."""

    def usable(value):
        return F.when(valid_food_name(value), value)

    def of_line(line):
        after_colon = usable(until_next_label(strip(F.regexp_extract(line, "(?s)^[^：:]*[：:](.*)$", 1))))
        options = []
        for keyword in keywords:
            rest = usable(until_next_label(strip(first_match(line, keyword + r"[：:\s]*(.+)", 1))))
            options.append(F.when(F.contains(line, F.lit(keyword)), F.coalesce(after_colon, rest)))
        return F.coalesce(*options)

    return first_by_priority(
        pages, "food_name", [_first_of_lines(1, of_line), _first_of_tables(2, keywords, lambda c: usable(strip(c)))]
    )


def conclusions(pages: DataFrame, keywords=V.CONCLUSION_KEYWORDS, pattern: str = V.CONCLUSION_PATTERN) -> DataFrame:
    """Conclusion: keyword line, first non-empty cell of a conclusion column, any line."""
    found = lambda c: first_match(c, pattern)
    return first_by_priority(
        pages, "conclusion",
        [
            _first_of_lines(1, lambda x: F.when(contains_any(x, keywords), found(x))),
            _first_of_tables(2, keywords, lambda c: F.when(strip(c) != "", strip(c))),
            _first_of_lines(3, found),
        ],
    )


# --- cited standards ----------------------------------------------------------------------------

def _row_texts() -> Column:
    """All table rows of a page as joined texts."""
    rows = F.flatten(F.coalesce(F.col("tables"), F.array().cast("array<array<array<string>>>")))
    return F.transform(rows, lambda r: F.array_join(r, " ", "None"))


def _with_triggers(pages: DataFrame, triggers) -> DataFrame:
    return (
        pages.withColumn("lines", page_lines())
        .withColumn("trigger", F.transform("lines", lambda x: contains_any(x, triggers)))
        .withColumn("row_texts", _row_texts())
    )


TRIGGERS = V.CONCLUSION_KEYWORDS + [V.SAMPLING_TRIGGER]


def cited_codes(
    pages: DataFrame, triggers=TRIGGERS, basis_words=V.BASIS_WORDS, find=codes.report_codes,
    ahead: int = V.CONCLUSION_WINDOW,
) -> DataFrame:
    """Codes of conclusion passages, first place kept: (report_id, code, page, part, opened, at, occurrence).

    A trigger line opens a window of itself and ``ahead`` lines. Its own codes always count, those of
    the other lines only in a basis sentence. Table rows need a trigger and a basis word.
    """

    def of_line(line, i):
        own = F.get(F.col("trigger"), i)
        since = F.greatest(i - ahead, F.lit(0))
        back = F.array_position(F.slice(F.col("trigger"), since + 1, i - since + 1), F.lit(True)).cast("int")
        opened = F.when(contains_any(line, basis_words) & (back > 0), since + back - 1).when(own, i)
        return F.struct(F.lit(0).alias("part"), opened.alias("opened"), i.alias("at"), line.alias("text"))

    def of_row(text, i):
        counts = contains_any(text, triggers) & contains_any(text, basis_words)
        return F.struct(F.lit(1).alias("part"), F.when(counts, i).alias("opened"), i.alias("at"), text.alias("text"))

    passages = F.filter(
        F.concat(F.transform("lines", of_line), F.transform("row_texts", of_row)), lambda x: x["opened"].isNotNull()
    )
    found = (
        _with_triggers(pages, triggers)
        .select("report_id", "page", F.explode(passages).alias("p"))
        .select("report_id", "page", "p.part", "p.opened", "p.at", F.posexplode(find(F.col("p.text"))).alias("occurrence", "code"))
    )
    return _first_place(found, [])


def cited_codes_with_title(
    pages: DataFrame, triggers=TRIGGERS, pattern: str = V.GB_REPORT, ahead: int = V.CONCLUSION_WINDOW
) -> DataFrame:
    """Codes with the title that follows them, the first (code, title) of each code kept."""
    parts = f"({pattern})(?=(《[^》]+》)?)(?=([^。；;]*))"

    def windows(line, i):
        text = F.array_join(F.slice(F.col("lines"), i + 1, ahead + 1), " ")
        opened = F.get(F.col("trigger"), i)
        return F.struct(F.lit(0).alias("part"), F.when(opened, i).alias("opened"), i.alias("at"), text.alias("text"))

    def of_row(text, i):
        return F.struct(
            F.lit(1).alias("part"), F.when(contains_any(text, triggers), i).alias("opened"), i.alias("at"),
            text.alias("text"),
        )

    passages = F.filter(
        F.concat(F.transform("lines", windows), F.transform("row_texts", of_row)), lambda x: x["opened"].isNotNull()
    )
    flat = F.regexp_replace(F.col("p.text"), r"\s+", " ")
    matches = F.arrays_zip(
        *[F.regexp_extract_all(flat, F.lit(parts), g).alias(n) for g, n in [(1, "code"), (2, "book"), (3, "rest")]]
    )
    raw = F.when(F.col("m.book") != "", F.regexp_replace("m.book", "[《》]", "")).otherwise(F.col("m.rest"))
    trimmed = F.btrim(strip(raw), F.lit(" ，,《》[]（）()"))
    title = strip(F.regexp_replace(trimmed, "的*要求$", ""))
    found = (
        _with_triggers(pages, triggers)
        .select("report_id", "page", F.explode(passages).alias("p"))
        .select("report_id", "page", "p.part", "p.opened", "p.at", F.posexplode(matches).alias("occurrence", "m"))
        .withColumn("code", strip("m.code"))
        .withColumn("title", F.when(title != "", title))
    )
    return _first_place(found, ["title"])


def _first_place(found: DataFrame, carried) -> DataFrame:
    place = ["page", "part", "opened", "at", "occurrence"]
    return (
        found.groupBy("report_id", "code")
        .agg(F.min(F.struct(*place, *carried)).alias("first"))
        .select("report_id", "code", *[F.col(f"first.{x}").alias(x) for x in place + list(carried)])
    )


# --- inspection items ---------------------------------------------------------------------------

def item_roles(table: Column) -> Column:
    """struct of the 0-based column of each role in a table, by its title."""
    return F.struct(*[_column_of(table, words).alias(role) for role, words in V.ITEM_COLUMN_TITLES.items()])


def inspection_items(pages: DataFrame) -> DataFrame:
    """Items of all tables with an item and a value column; the first of equal (item, value) stays."""

    def of_row(row, i, table_no, roles):
        cells = [repaired_cell(F.get(row, roles[f])).alias(f) for f in ITEM_FIELDS]
        return F.struct(table_no.alias("table_no"), i.alias("row_no"), *cells)

    def of_table(table, table_no):
        def rows_of(roles):
            usable = roles["item"].isNotNull() & roles["value"].isNotNull()
            below = F.slice(table, 2, F.greatest(F.size(table), F.lit(1)))
            rows = F.transform(F.filter(below, lambda r: usable), lambda row, i: of_row(row, i, table_no, roles))
            return F.filter(rows, lambda r: (r["item"] != "") | (r["value"] != "") | (r["standard"] != ""))

        return let(item_roles(table), rows_of)

    tables = F.filter(F.coalesce(F.col("tables"), F.array().cast("array<array<array<string>>>")), lambda t: F.size(t) > 0)
    found = pages.select("report_id", "page", F.inline(F.flatten(F.transform(tables, of_table))))
    return first_items(found, ["page", "table_no", "row_no"])


def first_items(items: DataFrame, place) -> DataFrame:
    """Keep the first of equal (item, value) per report, by the place columns."""
    rest = [c for c in items.columns if c not in {"report_id", "item", "value", *place}]
    return (
        items.groupBy("report_id", "item", "value")
        .agg(F.min(F.struct(*place, *rest)).alias("first"))
        .select("report_id", *[F.col(f"first.{c}").alias(c) for c in place], "item", "value",
                *[F.col(f"first.{c}").alias(c) for c in rest])
    )


def field_issues(summary: DataFrame) -> DataFrame:
    """One message per missing field; summary: (report_id, food_name, production_date, codes, items counts)."""
    missing = lambda c: col(c).isNull() | (col(c) == "")
    issues = F.array_compact(
        F.array(
            F.when(missing("food_name"), F.lit("缺少食品名称")),
            F.when(missing("production_date"), F.lit("缺少生产日期")),
            F.when(F.coalesce(F.col("n_codes"), F.lit(0)) == 0, F.lit("缺少国标号")),
            F.when(F.coalesce(F.col("n_items"), F.lit(0)) == 0, F.lit("未检测到检验项目表格")),
        )
    )
    return summary.select("report_id", F.posexplode(issues).alias("pos", "issue"))


def method_code_set(items: DataFrame) -> DataFrame:
    """Distinct method codes per report."""
    return items.select("report_id", F.explode(codes.method_codes("method")).alias("code")).distinct()


def all_codes(cited: DataFrame, items: DataFrame) -> DataFrame:
    """Cited codes plus method codes not cited yet, with their role."""
    cited = cited.select("report_id", "code").distinct()
    methods = method_code_set(items).join(cited, ["report_id", "code"], "left_anti")
    return cited.withColumn("role", F.lit("cited")).unionByName(methods.withColumn("role", F.lit("method")))
