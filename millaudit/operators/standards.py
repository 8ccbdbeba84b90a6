"""Validity of cited standards and the verdict store.

Every request is reduced to distinct (code, production_date) before any join, so a code cited by a third
of all reports is looked up once per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millaudit import fixed_values as V
from millaudit.functions import codes, dates
from millaudit.functions.text import col, contains_any, strip

VERDICT_FIELDS = [
    "passed", "status", "status_text", "publish_date", "implement_date", "abolish_date", "detail_url", "reasons", "error",
]


def in_force(status) -> Column:
    """Is a status text 'in force'? Partial, coming or abolished ones are not."""
    s = strip(F.coalesce(col(status), F.lit("")))
    return (
        F.when((s == "") | contains_any(s, ["废止", "作废", "停止"]), F.lit(False))
        .when(F.contains(s, F.lit("现行")) & F.contains(s, F.lit("有效")), F.lit(True))
        .otherwise(s == "有效")
    )


def inferred_status(status, implement_date, abolish_date) -> Column:
    """Status as given, else abolished with an abolition date, in force with an implementation date."""
    given = F.coalesce(col(status), F.lit(""))
    return (
        F.when(given != "", given)
        .when(~dates.is_blank(abolish_date), F.lit("已废止"))
        .when(~dates.is_blank(implement_date), F.lit("现行有效"))
    )


def is_empty_record() -> Column:
    """No status, date or link: the lookup failed rather than the standard being invalid."""
    fields = ["record_status", "implement_date", "abolish_date", "publish_date", "detail_url"]
    empty = F.lit(True)
    for f in fields:
        empty = empty & (F.coalesce(F.col(f), F.lit("")) == "")
    return empty


def distinct_requests(requests: DataFrame) -> DataFrame:
    return requests.select("code", "production_date").distinct()


def looked_up(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """The requests with the record of their standard, row by row; nulls where the registry has none.

    registry: (code, publish_date, implement_date, abolish_date, status, detail_url), joined on the standard number with year. Of several rows of one
    number, the one whose code equals the asked code counts, else the first by code and dates. The registry is reduced before the join, once per
    number and once per number and code, so requests may be a stream.
    """
    fields = ["publish_date", "implement_date", "abolish_date", "record_status", "detail_url"]
    order = ["_code", "implement_date", "publish_date", "abolish_date", "record_status", "detail_url"]

    def plain(c):
        return F.upper(F.regexp_replace(c, r"\s", ""))

    known = registry.select(
        codes.standard_number("code").alias("_number"), F.col("code").alias("_code"), "publish_date", "implement_date", "abolish_date",
        F.col("status").alias("record_status"), "detail_url",
    )
    first = known.groupBy("_number").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_first"), F.count("*").alias("_rows"))
    several = known.join(first.where("_rows > 1").select("_number"), "_number", "left_semi")
    equal = several.groupBy("_number", plain(F.col("_code")).alias("_plain")).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_equal"))
    asked = requests.withColumn("_number", codes.standard_number("code")).withColumn("_plain", plain(F.col("code")))
    found = asked.join(first, "_number", "left").join(equal, ["_number", "_plain"], "left").withColumn("_record", F.coalesce("_equal", "_first"))
    return found.select(*requests.columns, "_record.*")


def verdicts(requests: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """One verdict per (code, production_date), by the records that ``looked_up`` finds."""
    return judged(looked_up(distinct_requests(requests), registry), strict)


def judged(records: DataFrame, strict: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """Verdict of rows (code, production_date, record_status, publish_date, implement_date, abolish_date, detail_url), with the carried columns."""
    staged = (
        records.withColumn("_empty", is_empty_record())
        .withColumn("_status", inferred_status("record_status", "implement_date", "abolish_date"))
        .withColumn("_made", dates.flexible_date("production_date", strict))
        .withColumn("_from", dates.flexible_date("implement_date", strict))
    )
    status_reason = F.when(
        ~in_force("_status"),
        F.concat(F.lit("标准状态不是现行有效（当前为："), F.coalesce("_status", F.lit("未知")), F.lit("）")),
    )
    date_reason = (
        F.when(dates.is_blank("implement_date"), F.lit("缺少实施日期（implement_date）"))
        .when(F.col("_from").isNull(), F.concat(F.lit("实施日期无法解析（原值："), F.col("implement_date"), F.lit("）")))
        .when(
            F.col("_made") < F.col("_from"),
            F.concat(
                F.lit("生产日期早于实施日期（生产日期："), F.col("_made").cast("string"), F.lit("，实施日期："),
                F.col("_from").cast("string"), F.lit("）"),
            ),
        )
    )
    unreadable = ~F.col("_empty") & F.col("_made").isNull()
    reasons = (
        F.when(F.col("_empty"), F.array(F.lit("未能提取到任何标准信息（日期、状态、详情页 URL 均为空），请稍后重试")))
        .when(unreadable, F.array(F.concat(F.lit("验证过程出错: invalid date format: "), F.coalesce("production_date", F.lit("")))))
        .otherwise(F.array_compact(F.array(status_reason, date_reason)))
    )
    return (
        staged.withColumn("reasons", reasons)
        .withColumn("passed", F.size("reasons") == 0)
        .withColumn(
            "status",
            F.when(F.col("_empty") | unreadable, "error")
            .when(F.col("passed"), "valid")
            .when(F.contains(F.coalesce("_status", F.lit("")), F.lit("废止")), "obsolete")
            .otherwise("invalid"),
        )
        .withColumn(
            "status_text",
            F.when(F.col("_empty"), "无法获取标准信息").when(unreadable, "验证失败").otherwise(F.coalesce("_status", F.lit("未知"))),
        )
        .withColumn(
            "error",
            F.when(F.col("_empty"), "extraction_empty").when(unreadable, "invalid date format"),
        )
        .select("code", "production_date", *carried, *VERDICT_FIELDS)
    )


def unknown_verdicts(requests: DataFrame) -> DataFrame:
    """Verdicts when no registry is at hand."""
    return distinct_requests(requests).select(
        "code", "production_date", F.lit(False).alias("passed"), F.lit("unknown").alias("status"),
        F.lit("未配置验证服务").alias("status_text"),
        *[F.lit(None).cast("string").alias(c) for c in ["publish_date", "implement_date", "abolish_date", "detail_url"]],
        F.array(F.lit("未配置验证服务")).alias("reasons"), F.lit("Missing registry").alias("error"),
    )


# --- verdict store ------------------------------------------------------------------------------

def fresh(ts, now: float, ttl: float = V.VERDICT_TTL_SECONDS) -> Column:
    return (F.lit(float(now)) - F.coalesce(col(ts), F.lit(0.0))) < ttl


def cache_hits(requests: DataFrame, store: DataFrame, now: float) -> DataFrame:
    """Stored verdicts that still count at ``now`` (epoch seconds)."""
    return distinct_requests(requests).join(store.where(fresh("ts", now)), ["code", "production_date"])


def cache_misses(requests: DataFrame, store: DataFrame, now: float) -> DataFrame:
    return distinct_requests(requests).join(
        store.where(fresh("ts", now)).select("code", "production_date"), ["code", "production_date"], "left_anti"
    )


def stamped(new: DataFrame, now: float) -> DataFrame:
    """New verdicts with their time; errors are dated back so that they expire after an hour."""
    back = V.VERDICT_TTL_SECONDS - V.ERROR_TTL_SECONDS
    return new.withColumn("ts", F.lit(float(now)) - F.when(F.col("status") == "error", float(back)).otherwise(0.0))


def upserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with new rows over old ones of the same key."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.select(*store.columns).withColumn("_new", F.lit(1)))
    rest = [c for c in store.columns if c not in {"code", "production_date"}]
    return (
        both.groupBy("code", "production_date")
        .agg(F.max_by(F.struct(*rest), F.struct("_new", "ts")).alias("r"))
        .select("code", "production_date", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def validated(requests: DataFrame, registry: DataFrame, store: DataFrame, now: float):
    """(results, new store): fresh verdicts are reused, the rest is judged and stored."""
    hits = cache_hits(requests, store, now)
    new = stamped(verdicts(cache_misses(requests, store, now), registry), now)
    results = hits.select(*store.columns).unionByName(new.select(*store.columns))
    return results, upserted(store, new)


# --- per report ---------------------------------------------------------------------------------

def report_verdicts(report_codes: DataFrame, judged_codes: DataFrame) -> DataFrame:
    """Verdicts per report; report_codes: (report_id, code, production_date, …)."""
    return report_codes.join(judged_codes, ["code", "production_date"])


def all_passed(verdict_rows: DataFrame) -> DataFrame:
    """Did all standards of a report pass? Reports without standards have no row (null after a left join)."""
    return verdict_rows.groupBy("report_id").agg(F.bool_and("passed").alias("all_passed"))


def preferred_versions(verdict_rows: DataFrame) -> DataFrame:
    """One verdict per (report, code without year): the first with a year, else the first."""
    rest = [c for c in verdict_rows.columns if c not in {"report_id", "pos"}]
    return (
        verdict_rows.withColumn("base_code", codes.without_trailing_year("code"))
        .withColumn("_bare", ~codes.has_trailing_year("code"))
        .groupBy("report_id", "base_code")
        .agg(F.min(F.struct("_bare", "pos", *rest)).alias("r"))
        .select("report_id", "base_code", "r.pos", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def code_consistency(report_codes: DataFrame, matched: DataFrame) -> DataFrame:
    """Cited codes against the codes of the required bases, compared without year.

    report_codes: (report_id, pos, code); matched: (report_id, pos, required_basis). Of codes with the
    same key the last counts; rows without a cited code are gone.
    """
    cited = report_codes.groupBy("report_id", codes.without_trailing_year("code").alias("base_code")).agg(
        F.max_by("code", "pos").alias("report_code")
    )
    asked = (
        matched.select("report_id", "pos", F.posexplode(codes.consistency_codes("required_basis")).alias("at", "code"))
        .groupBy("report_id", codes.without_trailing_year("code").alias("base_code"))
        .agg(F.max(F.struct("pos", "at", "code")).alias("r"))
        .select("report_id", "base_code", F.col("r.code").alias("rule_code"))
    )
    return cited.join(asked, ["report_id", "base_code"], "left").withColumn(
        "label", F.when(F.col("rule_code").isNotNull(), "一致").otherwise("细则无要求")
    )


def verdict_reports(rows: DataFrame) -> DataFrame:
    """Readable text of each verdict."""
    numbered = F.transform("reasons", lambda r, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), r))
    or_unknown = lambda c, other="未知": F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(other))
    number = codes.standard_number("code")
    lines = [
        F.concat(F.lit("校验结论："), F.when(F.col("passed"), "通过").otherwise("不通过")),
        F.concat(F.lit("生产日期："), F.coalesce(dates.flexible_date("production_date").cast("string"), F.col("production_date"))),
        F.when(F.size("reasons") > 0, F.concat(F.lit("不通过原因：\n"), F.array_join(numbered, "\n"))),
        F.lit(""),
        F.lit("标准信息："),
        F.when(number != "", F.concat(F.lit("  - 国标号：GB "), number)).otherwise(F.lit("  - 国标号：未知")),
        F.concat(F.lit("  - 标准状态："), or_unknown("status_text")),
        F.concat(F.lit("  - 发布日期："), or_unknown("publish_date")),
        F.concat(F.lit("  - 实施日期："), or_unknown("implement_date")),
        F.concat(F.lit("  - 废止日期："), or_unknown("abolish_date", "未知/未提供")),
        F.concat(F.lit("  - 详情页："), or_unknown("detail_url")),
    ]
    return rows.withColumn("report_text", F.concat_ws("\n", *lines))


def check_rows(requests: DataFrame, judged_codes: DataFrame) -> DataFrame:
    """Answer rows of a standard check; a missing production date takes the default."""
    asked = requests.withColumn("production_date", F.coalesce("production_date", F.lit(V.DEFAULT_PRODUCTION_DATE)))
    return asked.join(judged_codes, ["code", "production_date"], "left").select(
        *[c for c in asked.columns],
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("status_text", F.lit("未知")).alias("status_text"),
        F.coalesce("passed", F.lit(False)).alias("passed"),
        "publish_date", "implement_date", "abolish_date", "detail_url", "reasons",
    )


# --- records from pages -------------------------------------------------------------------------

def page_records(pages: DataFrame, text: str = "html") -> DataFrame:
    """Standard fields of detail pages, next to the columns that are there."""
    from millaudit.functions import html

    return (
        pages.withColumn("page_number", html.page_standard_number(text))
        .withColumn("page_publish_date", html.labelled_cell(text, "发布日期"))
        .withColumn("page_implement_date", html.labelled_cell(text, "实施日期"))
        .withColumn("page_abolish_date", html.labelled_cell(text, "废止日期"))
        .withColumn("page_status", html.page_status(text))
    )


def overlaid_records(records: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Records with non-null fields of their detail page over their own; links stay."""
    new = page_records(pages)
    joined = records.join(
        new.select(key, "page_number", "page_publish_date", "page_implement_date", "page_abolish_date", "page_status"), key, "left"
    )
    return joined.select(
        key,
        F.coalesce("page_number", "gb_number").alias("gb_number"),
        F.coalesce("page_publish_date", "publish_date").alias("publish_date"),
        F.coalesce("page_implement_date", "implement_date").alias("implement_date"),
        F.coalesce("page_abolish_date", "abolish_date").alias("abolish_date"),
        F.coalesce("page_status", "status").alias("status"),
        "detail_url",
    )


def search_records(rows: DataFrame, variants, detail_variants, number: str = "gb_number") -> DataFrame:
    """Records of search results: first readable field over the page variants in order, then the detail
    texts for the abolition date, then the status words of any text."""
    from millaudit.functions import html

    dates_of = [html.search_page_dates(v) for v in variants]
    links = [html.search_page_link(v) for v in variants]
    states = [html.search_page_status(v, number) for v in variants]
    status = F.coalesce(*states, *[html.status_from_text(v) for v in reversed(variants)])
    return rows.select(
        *[c for c in rows.columns if c not in set(variants) | set(detail_variants)],
        F.concat(F.lit(V.SEARCH_LINK_PREFIX), F.col(number)).alias("search_url"),
        F.coalesce(*[d["publish_date"] for d in dates_of]).alias("publish_date"),
        F.coalesce(*[d["implement_date"] for d in dates_of]).alias("implement_date"),
        F.coalesce(*[html.abolish_date(v) for v in detail_variants]).alias("abolish_date"),
        status.alias("status"),
        F.coalesce(*links).alias("detail_url"),
    )


def first_links(results: DataFrame, pattern: str = V.DETAIL_LINK) -> DataFrame:
    """First result of a search whose link has the pattern; results: (query_id, pos, url)."""
    return results.where(F.col("url").rlike(pattern)).groupBy("query_id").agg(F.min_by("url", "pos").alias("url"))
