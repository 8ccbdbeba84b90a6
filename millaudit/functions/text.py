"""Text columns: blanks, brackets, item names, safe names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from millaudit import fixed_values as V

# The blanks of the report texts: Java's \s is ASCII only, so the class is spelled out.
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{4e00}-\x{9fa5}]"
BLANKS = "".join(
    chr(x) for x in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
FULL_WIDTH_DIGITS = "０１２３４５６７８９"
HALF_WIDTH_DIGITS = "0123456789"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c) -> Column:
    """Without leading and trailing blanks."""
    return F.btrim(col(c), F.lit(BLANKS))


def without_blanks(c) -> Column:
    return F.translate(col(c), BLANKS, "")


def squash(c) -> Column:
    """Runs of blanks become one space; ends are stripped."""
    return strip(F.regexp_replace(col(c), f"{BLANK}+", " "))


def contains_any(c, words) -> Column:
    """True where the text contains one of a fixed list of words."""
    return reduce(lambda a, b: a | b, [F.contains(col(c), F.lit(w)) for w in words])


def first_match(c, pattern: str, group: int = 0) -> Column:
    """Text of the first match, null where there is none."""
    c = col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def all_matches(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), group)


def half_width(c) -> Column:
    return F.translate(col(c), FULL_WIDTH_DIGITS, HALF_WIDTH_DIGITS)


def number(c) -> Column:
    """A number text as double, null where it is none (two dots, a lone dot, blank)."""
    # An empty text is not cast: a failed cast costs far more than the test.
    return let(col(c), lambda v: F.when(v != "", half_width(v).try_cast("double")))


def number_text(c) -> Column:
    """A double as plain decimal text, without exponent for everyday sizes."""
    c = col(c)
    plain = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "(\\.\\d+?)0+$", "$1")
    odd = (F.abs(c) >= 1e7) | ((F.abs(c) < 1e-3) & (c != 0))
    return F.when(odd & (F.abs(c) < 1e16), plain).otherwise(c.cast("string"))


def distinct_sorted_text(values: Column, separator: str = " ") -> Column:
    return F.array_join(F.sort_array(F.array_distinct(values)), separator)


# --- item names ---------------------------------------------------------------------------------

def name_core(c) -> Column:
    """Item name up to the first bracket, blanks dropped."""
    return without_blanks(F.regexp_replace(col(c), r"(?s)[(（].*$", ""))


def is_composite(c) -> Column:
    """Ratio, share, sum or total: such names never match their components."""
    return col(c).rlike(V.COMPOSITE_PATTERN)


def composite_synonym(c) -> Column:
    """One wording for composites that mean the same."""
    c = F.regexp_replace(col(c), "占(.+?)含量$", "占$1总量")
    return F.regexp_replace(c, "比例$", "比值")


def extends_with_code(short, long) -> Column:
    """The text right after the first occurrence goes on with a digit or a Latin letter (B1 in B12)."""
    nxt = F.substring(col(long), F.instr(col(long), col(short)) + F.length(col(short)), F.lit(1))
    return nxt.rlike(r"^[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}A-Za-z]")


def guarded_contains(short, long, least: int = 3) -> Column:
    """The shorter name lies in the longer one and is not a prefix of a more specific code."""
    short, long = col(short), col(long)
    return (F.length(short) >= least) & F.contains(long, short) & ~extends_with_code(short, long)


def name_parts(c) -> Column:
    """Names a merged (already normalised) name is made of; a single name gives itself."""
    c = col(c)
    whole = F.array(c)
    words = lambda texts: F.array(*[F.lit(t) for t in texts])

    def first_split(ways):
        """The first way that gives at least two parts, null when none does."""
        return F.get(F.filter(ways, lambda parts: F.size(parts) >= 2), F.lit(0))

    by_separator = first_split(
        F.transform(words(V.NAME_SEPARATORS), lambda s: F.filter(F.split(c, s), lambda p: p != ""))
    )
    kinds = F.size(F.filter(words(V.NAME_SUFFIXES), lambda s: F.contains(c, s)))
    by_suffix = first_split(
        F.transform(words(V.NAME_SUFFIXES), lambda s: F.regexp_extract_all(c, F.concat(F.lit("(?s)(.*?"), s, F.lit(")")), 1))
    )
    # A part that is a composite of its own means the cut was wrong; the suffix rule comes last.
    checked = let(
        by_separator,
        lambda parts: F.when(F.exists(parts, is_composite), whole).otherwise(
            F.coalesce(parts, F.when(kinds >= 2, by_suffix), whole)
        ),
    )
    return (
        F.when(c == "", F.array().cast("array<string>"))
        .when((F.length(c) <= 6) | is_composite(c), whole)
        .otherwise(checked)
    )


def name_without_unit_note(c) -> Column:
    """Item name without its '（以…计）' note."""
    return strip(F.regexp_replace(col(c), "[（(]以[^）)]+计[）)]", ""))


def name_without_notes(c) -> Column:
    """Item name without bracket notes."""
    return strip(F.regexp_replace(col(c), r"[\s（(][^）)]*[）)]", ""))


def name_without_bracket_text(c) -> Column:
    return strip(F.regexp_replace(col(c), "[（(][^）)]*[）)]", ""))


# --- cells --------------------------------------------------------------------------------------

def repaired_cell(c) -> Column:
    """Cell text with wrapped subscripts put back behind their letter and line breaks joined."""
    c = F.regexp_replace(col(c), r"([A-Za-z])\s+([^\n]*?\))\s*\n\s*(\d+)\b", "$1$3$2")
    c = F.regexp_replace(c, r"(?<=[A-Za-z\x{4e00}-\x{9fa5})）])\s*\n\s*(\d+)(?=\s|\n|$)", "$1")
    c = F.regexp_replace(c, r"([^\s])\n([^\s])", "$1$2")
    c = F.regexp_replace(c, r"\n", " ")
    c = F.regexp_replace(c, "  +", " ")
    return F.coalesce(strip(c), F.lit(""))


def without_bracket_blanks(c) -> Column:
    """Blanks inside (nested) brackets are wrap artefacts and go; others stay."""
    c = col(c)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc, ch):
        depth = (
            F.when(ch.isin("（", "("), acc["depth"] + 1)
            .when(ch.isin("）", ")"), acc["depth"] - 1)
            .otherwise(acc["depth"])
        )
        kept = F.when((ch == " ") & (acc["depth"] > 0), F.lit("")).otherwise(ch)
        return F.struct(depth.alias("depth"), F.concat(acc["out"], kept).alias("out"))

    folded = F.aggregate(F.split(c, ""), start, step, lambda acc: acc["out"])
    return F.when(F.contains(c, F.lit(" ")) & c.rlike("[（(]"), folded).otherwise(c)


def cell_lines(c) -> Column:
    """Non-empty stripped lines of a cell."""
    return F.filter(F.transform(F.split(col(c), "\n"), strip), lambda x: x != "")


def food_lines(c) -> Column:
    """Lines of a cell without leading numbering or bullets."""
    return F.filter(
        F.transform(cell_lines(c), lambda x: F.regexp_replace(x, r"^[\p{Nd}.\-*\s]+", "")),
        lambda x: x != "",
    )


def joined_cells(cells, separator: str = " ") -> Column:
    return F.array_join(F.filter(F.transform(col(cells), strip), lambda x: x.isNotNull() & (x != "")), separator)


def indent_levels(c) -> Column:
    """(text, indent, level) per line; lines are stripped first, so both numbers are 0."""
    return F.transform(
        cell_lines(c), lambda x: F.struct(x.alias("text"), F.lit(0).alias("indent"), F.lit(0).alias("level"))
    )


# --- normal forms -------------------------------------------------------------------------------

def half_width_signs(c) -> Column:
    """No blanks; full-width digits, waves and colons become half-width."""
    return F.translate(without_blanks(c), FULL_WIDTH_DIGITS + "～〜∶：", HALF_WIDTH_DIGITS + "~~::")


def safe_file_name(c) -> Column:
    return F.translate(col(c), "/\\", "--")


def screenshot_name(c) -> Column:
    bare = strip(F.regexp_replace(col(c), r"(?i)^\s*GB(?:/T)?\s*", ""))
    return F.concat(F.lit("gb_"), safe_file_name(F.regexp_replace(bare, " ", "")), F.lit("_detail.png"))
