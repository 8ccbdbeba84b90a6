"""HTML texts: tables as nested arrays, page fields, links. One row holds one text, so nothing shuffles."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from millaudit import fixed_values as V
from millaudit.functions.text import BLANK, all_matches, col, contains_any, first_match, let, squash, strip

_TABLE = r"(?is)<table\b[^>]*>.*?(?:</table>|\z)"
_ROW = r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|</table>|\z)"
_CELL = r"(?is)<(t[dh])\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\z)"
#: Every named character reference with its end sign; a fixed blank reads as a blank.
_NAMED = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")} | {"nbsp": " "})
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_DAY = r"(?<![A-Za-z0-9_])(\d{4}-\d{2}-\d{2})(?![A-Za-z0-9_])"


def without_tags(c) -> Column:
    return F.regexp_replace(col(c), "<[^>]+>", "")


def unescaped(c) -> Column:
    """Character references resolved once, numeric ones and all named ones; unknown ones stay as they are."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def sign(name):
        digits = F.when(F.lower(F.substr(name, F.lit(2), F.lit(1))) == "x", F.lpad(F.substr(name, F.lit(3)), 8, "0"))
        point = F.coalesce(F.conv(digits, 16, 10), F.substr(name, F.lit(2))).cast("int")
        valid = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
        return F.when(F.startswith(name, F.lit("#")), number).otherwise(F.try_element_at(named, name))

    def part(p):
        name = F.regexp_extract(p, _REFERENCE, 1)
        found = F.when(name != "", F.concat(sign(name), F.substr(p, F.length(name) + 2)))
        return F.coalesce(found, F.concat(F.lit("&"), p))

    def resolved(x):
        parts = F.split(x, "&")
        plain = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), part), ""))
        return F.when(F.contains(x, F.lit("&")), plain).otherwise(x)

    return let(col(c), resolved)


def cell_text(c) -> Column:
    """Text of a cell: tags dropped, entities resolved, blanks squashed; plain texts skip the patterns."""
    bare = let(col(c), lambda x: F.when(F.contains(x, F.lit("<")), without_tags(x)).otherwise(x))
    return let(unescaped(bare), lambda x: F.when(x.rlike(BLANK), squash(x)).otherwise(x))


def has_table(c) -> Column:
    return F.contains(F.lower(col(c)), F.lit("<table"))


def tables(c) -> Column:
    """array<table<row<struct(tag, text)>>> of all tables of a text."""

    def cells(row):
        return F.transform(
            F.arrays_zip(all_matches(row, _CELL, 1).alias("tag"), all_matches(row, _CELL, 2).alias("text")),
            lambda x: F.struct(F.lower(x["tag"]).alias("tag"), cell_text(x["text"]).alias("text")),
        )

    return F.transform(all_matches(c, _TABLE), lambda t: F.transform(all_matches(t, _ROW, 1), cells))


def header_row(table: Column) -> Column:
    """1-based position of the header row: the first with a <th>, else the first row."""
    marked = F.array_position(
        F.transform(table, lambda r: F.exists(r, lambda x: x["tag"] == "th")), F.lit(True)
    ).cast("int")
    return F.greatest(marked, F.lit(1))


def header_texts(table: Column, at: Column) -> Column:
    """Header texts of the header row; empty when the table has none."""

    def texts(row):
        marked = F.exists(row, lambda x: x["tag"] == "th")
        source = F.transform(F.filter(row, lambda x: ~marked | (x["tag"] == "th")), lambda x: x["text"])
        return F.when(marked | F.exists(source, lambda h: h != ""), source).otherwise(F.array().cast("array<string>"))

    return let(F.get(table, at - 1), texts)


def data_rows(c) -> Column:
    """array<struct(table_no, row_no, headers, cells)> of a text: td cells below each header, empty rows gone."""

    def below(table, table_no, at, headers):
        rows = F.transform(
            F.slice(table, at + 1, F.greatest(F.size(table), F.lit(1))),
            lambda r, i: F.struct(
                (table_no + 1).alias("table_no"),
                (i + 1).alias("row_no"),
                headers.alias("headers"),
                F.transform(
                    F.slice(F.filter(r, lambda x: x["tag"] == "td"), F.lit(1), F.size(headers)), lambda x: x["text"]
                ).alias("cells"),
            ),
        )
        return F.filter(rows, lambda r: F.exists(r["cells"], lambda t: t != ""))

    def rows_of(table, table_no):
        return let(
            header_row(table), lambda at: let(header_texts(table, at), lambda headers: below(table, table_no, at, headers))
        )

    return F.flatten(F.transform(tables(c), rows_of))


def simple_rows(c) -> Column:
    """Rows of plain <tr><td> tables as arrays of texts."""
    return F.filter(
        F.transform(all_matches(c, "(?s)<tr>(.*?)</tr>", 1), lambda r: all_matches(r, "<td>(.*?)</td>", 1)),
        lambda r: F.size(r) > 0,
    )


def first_row_width(c) -> Column:
    """Cells of the first row."""
    return F.size(all_matches(F.substring_index(col(c), "</tr>", 1), "<t[dh]"))


def first_row_texts(c) -> Column:
    row = F.regexp_extract(col(c), "(?s)<tr[^>]*>(.*?)</tr>", 1)
    return F.transform(all_matches(row, "<t[dh][^>]*>(.*?)</t[dh]>", 1), lambda x: strip(without_tags(x)))


# --- standard pages -----------------------------------------------------------------------------

def _from(c: Column, at: Column, size: int) -> Column:
    return F.substring(c, at, F.lit(size))


def text_between(c, start: str, end: str) -> Column:
    """Text between two markers, tags dropped, null when either is missing or nothing is left."""
    c = col(c)
    at = F.instr(c, F.lit(start))
    begin = at + len(start)
    stop = F.position(F.lit(end), c, begin)
    inner = strip(without_tags(F.substring(c, begin, stop - begin)))
    return F.when((at > 0) & (stop > 0) & (inner != ""), inner)


def cropped(c, start: str = V.PAGE_CROP_START, end: str = V.PAGE_CROP_END) -> Column:
    """Page part between two markers; to the end without the second, whole page without the first."""
    c = col(c)
    at = F.instr(c, F.lit(start))
    stop = F.position(F.lit(end), c, F.greatest(at, F.lit(1)))
    size = F.when(stop > 0, stop - at).otherwise(F.length(c))
    return F.when(at > 0, F.substring(c, at, size)).otherwise(c)


def labelled_cell(c, label: str) -> Column:
    """Text of the cell after a header cell; placeholders are null."""
    raw = first_match(c, rf"(?is)<th[^>]*>\s*\Q{label}\E\s*</th>\s*<td[^>]*>(.*?)</td>", 1)
    text = strip(without_tags(raw))
    return F.when(~text.isin("暂无", "", "/"), text)


def status_by_image(c) -> Column:
    c = col(c)
    result = F.lit(None).cast("string")
    for image, status in reversed(V.STATUS_BY_IMAGE.items()):
        result = F.when(F.contains(c, F.lit(image)), F.lit(status)).otherwise(result)
    return result


def page_status(c) -> Column:
    """Status of a detail page: image name, else words of the status cell (else of the page)."""
    c = col(c)
    block = F.coalesce(first_match(c, r"(?is)<th[^>]*>\s*标准状态\s*</th>(.*?)</td>", 1), c)
    words = (
        F.when(F.contains(block, F.lit("现行有效")), F.lit("现行有效"))
        .when(contains_any(block, ["已废止", "yjfz", "作废"]), F.lit("已废止"))
        .when(F.contains(block, F.lit("即将实施")), F.lit("即将实施"))
    )
    return F.coalesce(status_by_image(c), words)


def marked_status(c, start: str = '<th bgcolor="#FFFFFF">标准状态</th>', end: str = '<th bgcolor="#FFFFFF">实施日期</th>') -> Column:
    """Older rule: status by two images between fixed markers, null without the markers."""
    c = col(c)
    block = first_match(c, rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1)
    return F.when(F.contains(block, F.lit("yjfz.gif")), "已废止").when(F.contains(block, F.lit("xxyx.gif")), "现行有效")


def marked_cell(c, label: str) -> Column:
    """Older rule: text of the cell behind a header with fixed markup; '暂无' is null."""
    text = text_between(c, f'<th bgcolor="#FFFFFF">{label}</th>', "</td>")
    return F.when(text != "暂无", text)


def page_standard_number(c) -> Column:
    return first_match(c, r"<span>(GB\s+[\d.\-/]+)", 1)


def download_link(c) -> Column:
    return first_match(c, V.DOWNLOAD_LINK, 1)


def detail_links(c, pattern: str = V.DETAIL_LINK, most: int = 50) -> Column:
    """Distinct detail links in order, at most ``most``."""
    return F.slice(F.array_distinct(all_matches(c, pattern)), 1, most)


def _day_after(c: Column, label: str, size: int) -> Column:
    at = F.instr(c, F.lit(label))
    return F.when(at > 0, first_match(_from(c, at, size), _DAY, 1))


def search_page_dates(c) -> Column:
    """struct(publish_date, implement_date): after their labels, else the first two days after a code."""
    c = col(c)
    code = first_match(c, r"(?<![A-Za-z0-9_])GB\s*\d+-\d{4}(?![A-Za-z0-9_])")
    near = F.when(code.isNotNull(), all_matches(_from(c, F.instr(c, code), 1200), _DAY, 1))
    return F.struct(
        F.coalesce(_day_after(c, "发布日期", 500), F.get(near, F.lit(0))).alias("publish_date"),
        F.coalesce(_day_after(c, "实施日期", 500), F.get(near, F.lit(1))).alias("implement_date"),
    )


def search_page_link(c, pattern: str = V.DETAIL_LINK) -> Column:
    return first_match(c, pattern)


def search_page_status(c, number) -> Column:
    """Status image within 400 characters of the code."""
    c, number = col(c), col(number)
    full = F.instr(c, F.concat(F.lit("GB "), number))
    at = F.when(full > 0, full).otherwise(F.instr(c, number))
    begin = F.greatest(at - 400, F.lit(1))
    return F.when(at > 0, status_by_image(F.substring(c, begin, at + 400 - begin)))


def abolish_date(c) -> Column:
    """Abolition day after the first of four labels that occurs."""
    c = col(c)
    result = F.lit(None).cast("string")
    for label in ["废止时间", "停止实施日期", "作废日期", "废止日期"]:
        result = F.when(F.contains(c, F.lit(label)), _day_after(c, label, 300)).otherwise(result)
    return result


def status_from_text(c) -> Column:
    """Status of any text: images, then words; the bare abolition label counts as abolished."""
    c = col(c)
    return (
        F.when(F.contains(c, F.lit("xxyx.gif")), F.lit("现行有效"))
        .when(F.contains(c, F.lit("yjfz.gif")), F.lit("已废止"))
        .when(F.contains(c, F.lit("现行有效")) & ~contains_any(c, ["已废止", "作废"]), F.lit("现行有效"))
        .when(contains_any(c, ["已废止", "作废", "废止日期"]), F.lit("已废止"))
    )
