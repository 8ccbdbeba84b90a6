"""Required items against reported items.

Names are matched once per distinct core, never per report pair. Containment is an
equi-join: every text of up to KEY characters inside the longer name is a key, so candidates are true
containments (names above KEY characters meet on their first KEY characters and are checked).
Items are dealt by report once; what follows per report stays in that deal, and rules meet it as small tables
that every executor has. The lines of one report stream through one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from millaudit.functions import codes
from millaudit.functions.text import (
    col, composite_synonym, guarded_contains, is_composite, name_core, name_parts, strip, without_blanks,
)
from millaudit.operators.common import block_positions
from millaudit.session import by_report, stored, stored_few

KEY = 32
LEAST = 3
LIST = 4096


def _inner_texts(text: Column) -> Column:
    """All texts of LEAST to KEY characters inside a text."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - LEAST + 1, F.lit(1)))
    pieces = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(LEAST), F.greatest(F.least(F.lit(KEY), n - i + 1), F.lit(LEAST))),
                lambda size: F.substring(text, i, size),
            ),
        )
    )
    return F.when(n >= LEAST, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _token(kind: str, role: str, key: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), key.alias("key"), text.alias("text"))


def name_tokens(names: DataFrame, name: str) -> DataFrame:
    """Match keys of distinct names: exact, composite synonym, whole containment, part equality and containment."""
    core, composite = F.col("core"), F.col("composite")
    staged = (
        names.withColumn("core", name_core(name))
        .withColumn("composite", is_composite("core"))
        .withColumn("synonym", composite_synonym("core"))
        .withColumn("parts", F.when(~composite, name_parts("core")).otherwise(F.array().cast("array<string>")))
    )
    whole = F.when(~composite & (F.length(core) >= LEAST), F.array(core)).otherwise(F.array().cast("array<string>"))

    def short(kind, texts):
        long_enough = F.filter(texts, lambda t: F.length(t) >= LEAST)
        return F.transform(long_enough, lambda t: _token(kind, "short", F.substring(t, 1, KEY), t))

    def long(kind, texts):
        return F.flatten(
            F.transform(texts, lambda t: F.transform(_inner_texts(t), lambda k: _token(kind, "long", k, t)))
        )

    tokens = F.concat(
        F.array(_token("exact", "equal", core, core)),
        F.array(_token("synonym", "equal", F.col("synonym"), F.col("synonym"))),
        F.transform(F.array_distinct("parts"), lambda p: _token("part", "equal", p, p)),
        short("whole", whole), long("whole", whole),
        short("part", F.array_distinct("parts")), long("part", F.array_distinct("parts")),
    )
    return staged.select(*names.columns, "composite", F.inline(tokens))


def core_pairs(reported: DataFrame, required: DataFrame) -> DataFrame:
    """Matching pairs of distinct name cores: (report_core, item_core). A core is compared once, however many categories and full names have it."""
    left = name_tokens(reported, "core").alias("a")
    mirror = F.when(F.col("role") == "short", "long").when(F.col("role") == "long", "short").otherwise("equal")
    right = name_tokens(required, "core").withColumn("role", mirror).alias("b")
    met = left.join(right, ["kind", "role", "key"])
    a, b = F.col("a.text"), F.col("b.text")
    a_short = F.col("role") == "short"
    short, long = F.when(a_short, a).otherwise(b), F.when(a_short, b).otherwise(a)
    good = (
        F.when(F.col("kind") == "synonym", F.col("a.composite") | F.col("b.composite"))
        .when(F.col("role") == "equal", F.lit(True))
        .otherwise(guarded_contains(short, long, LEAST))
    )
    return met.where(good).select(F.col("a.core").alias("report_core"), F.col("b.core").alias("item_core")).distinct()


def name_pairs(reported: DataFrame, required: DataFrame) -> DataFrame:
    """Matching pairs of names within a category: (category, report_name, item_name, match_type)."""
    spark = reported.sparkSession
    left = stored(spark, reported.select("category", "report_name").distinct().withColumn("report_core", name_core("report_name")), "names")
    right = stored(spark, required.select("category", "item_name").distinct().withColumn("item_core", name_core("item_name")), "names")
    cores = core_pairs(
        left.select(F.col("report_core").alias("core")).distinct(), right.select(F.col("item_core").alias("core")).distinct()
    )
    return (
        left.join(right.join(cores, "item_core"), ["category", "report_core"])
        .select("category", "report_name", "item_name",
                F.when(F.col("report_core") == F.col("item_core"), "exact").otherwise("fuzzy").alias("match_type"))
    )


def last_items(items: DataFrame, name: str = "item", place: str = "pos") -> DataFrame:
    """One row per (report, name): the last item's fields at the first place.

    The rows are dealt by report, so whatever follows per report needs no further exchange.
    """
    rest = [c for c in items.columns if c not in {"report_id", "category", name, place}]
    keys = [c for c in ["report_id", "category", name] if c in items.columns]
    return (
        by_report(items.where(F.col(name) != ""))
        .groupBy(*keys)
        .agg(F.min(place).alias(place), F.max(F.struct(place, *rest)).alias("last"))
        .select(*keys, place, *[F.col(f"last.{c}").alias(c) for c in rest])
    )


def first_rule_items(rules: DataFrame) -> DataFrame:
    """Required items, the first of each name per category, header names gone."""
    from millaudit.fixed_values import RULE_HEADER_NAMES

    rest = [c for c in rules.columns if c not in {"category", "item_name", "pos"}]
    return (
        rules.where((strip("item_name") != "") & ~strip("item_name").isin(RULE_HEADER_NAMES))
        .groupBy("category", "item_name")
        .agg(F.min(F.struct("pos", *rest)).alias("first"))
        .select("category", "item_name", "first.*")
    )


def with_unified_basis(rules: DataFrame) -> DataFrame:
    """Adds required_basis: the item's own basis, else all distinct GB bases of the category, sorted."""
    basis = strip("standard_basis")
    gb = F.when(basis.rlike("(?i)^GB"), basis)
    unified = rules.groupBy("category").agg(
        F.array_join(F.sort_array(F.collect_set(gb)), " ").alias("unified_basis")
    )
    return (
        rules.join(unified, "category", "left")
        .withColumn(
            "required_basis",
            F.when(F.coalesce(F.col("standard_basis"), F.lit("")) != "", F.col("standard_basis"))
            .otherwise(F.col("unified_basis")),
        )
        .drop("unified_basis")
    )


def met_rules(items: DataFrame, rules: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with the number of every rule they match, rules with their numbers).

    Rules go by number and a name's rules as lists, so that the matches of an item grow out of its own row, where its report is.
    """
    spark = items.sparkSession
    numbered = stored_few(spark, rules.withColumn("rule_no", F.monotonically_increasing_id()), "rules")
    partners = (
        pairs.join(numbered.select("category", "item_name", "rule_no"), ["category", "item_name"])
        .groupBy("category", "report_name", "match_type", F.floor(F.col("rule_no") / LIST).alias("part"))
        .agg(F.collect_list("rule_no").alias("rule_nos"))
        .drop("part")
    )
    met = items.withColumnRenamed("item", "report_name").join(stored_few(spark, partners, "partners"), ["category", "report_name"])
    return met.withColumn("rule_no", F.explode("rule_nos")).drop("rule_nos"), numbered


def matched_items(items: DataFrame, rules: DataFrame, pairs: DataFrame) -> DataFrame:
    """First matching reported item (in report order) of each required item.

    items: last_items(); rules: first_rule_items(). One reported item may serve several required ones.
    Of method, value, standard and unit only those the items have are carried.
    """
    carried = [c for c in ["method", "value", "standard", "unit"] if c in items.columns]
    out = {"method": "report_method", "value": "value", "standard": "report_standard", "unit": "report_unit"}
    met, numbered = met_rules(items, rules, pairs)
    best = met.groupBy("report_id", "category", "rule_no").agg(F.min(F.struct("pos", "report_name", "match_type", *carried)).alias("m"))
    return best.join(numbered.withColumnRenamed("pos", "rule_pos"), ["category", "rule_no"]).select(
        "report_id", "category", F.col("item_name").alias("name"), "m.report_name", "m.match_type", "condition",
        F.col("test_method").alias("required_method"), F.col("standard_basis").alias("required_basis"), "source_page", "rule_pos",
        *[F.col(f"m.{c}").alias(out[c]) for c in carried],
    )


def unmatched_rules(reports: DataFrame, rules: DataFrame, matched: DataFrame) -> DataFrame:
    """Required items without a match: kind 'missing', or 'conditional' when the rule has a condition.

    The rules of a category are numbered; the matched ones of a report are bits, 64 to a row. So only these rows
    are joined, never all required items of all reports.
    """
    spark = reports.sparkSession
    required = rules.select("category", F.col("item_name").alias("name"), "condition", F.col("pos").alias("rule_pos")).withColumn(
        "bucket", F.pmod(F.xxhash64("name"), F.lit(256))
    )
    place = F.col("place") - 1
    numbered = stored_few(
        spark,
        block_positions(required, ["category"], ["bucket"], ["name"], "place")
        .select("category", "name", "condition", "rule_pos", F.floor(place / 64).alias("block"), F.expr("shiftleft(1L, CAST((place - 1) % 64 AS INT))").alias("bit")),
        "numbered",
    )
    asked = stored(spark, reports.select("report_id", "category"), "asked")
    hits = (
        matched.select("report_id", "name").join(asked.distinct(), "report_id")
        .join(numbered.select("category", "name", "block", "bit"), ["category", "name"])
        .groupBy("report_id", "category", "block").agg(F.bit_or("bit").alias("hits"))
    )
    blocks = stored_few(spark, numbered.select("category", "block").distinct(), "blocks")
    left = by_report(asked).join(blocks, "category").join(hits, ["report_id", "category", "block"], "left")
    return left.join(numbered, ["category", "block"]).where(F.coalesce("hits", F.lit(0)).bitwiseAND(F.col("bit")) == 0).select(
        "report_id", "category", "name", "condition", "rule_pos",
        F.when(F.coalesce(F.col("condition"), F.lit("")) == "", "missing").otherwise("conditional").alias("kind"),
    )


def extra_items(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reported items that match no required item of their category."""
    known = stored_few(items.sparkSession, pairs.select("category", F.col("report_name").alias("item")).distinct(), "known")
    return items.join(known, ["category", "item"], "left_anti").select("report_id", "category", "item", "pos")


def synonym_items(missing: DataFrame, extra: DataFrame, pairs: DataFrame) -> DataFrame:
    """Missing items matched by extra ones. Empty by construction; kept as a checked invariant.

    The extra items meet the pairs first, in the categories their report has missing items of: few of them match anything.
    """
    spark = missing.sparkSession
    named = pairs.select("category", F.col("item_name").alias("name"), F.col("report_name").alias("item"))
    candidates = (
        missing.select("report_id", "category").distinct().join(extra.select("report_id", "item"), "report_id")
        .join(stored_few(spark, named, "named"), ["category", "item"])
    )
    return missing.join(stored_few(spark, candidates, "candidates"), ["report_id", "category", "name"]).select("report_id", "name", "item")


def one_to_one(candidates: DataFrame) -> DataFrame:
    """Each open name takes the first item that matches and is not taken yet, in the order of the names; every item is taken once.

    candidates: (report_id, name, rule_pos, item, pos), the matches of a report's open names with its items, order columns not null. A report's
    candidates are sorted by name and item in one task; one scan then keeps the taken items of one report at a time.
    """
    places, names = Window.partitionBy("report_id").orderBy("pos", "item"), Window.partitionBy("report_id").orderBy("rule_pos", "name")
    rows = (
        candidates.select("report_id", "name", "rule_pos", "item", "pos").distinct()
        .withColumn("item_no", F.dense_rank().over(places))
        .withColumn("name_no", F.dense_rank().over(names))
        .select("report_id", "name_no", "item_no", "name", "item")
    )
    return rows.sortWithinPartitions("report_id", "name_no", "item_no").mapInArrow(_taken, rows.schema).select("report_id", "name", "item")


def _taken(batches):
    """Rows (report_id, name_no, item_no, …) sorted by these, to those taken: a report's names in order, each its first free item."""
    report, name, taken, served = object(), None, set(), False
    for batch in batches:
        keep = []
        for i, (r, n, item) in enumerate(zip(batch["report_id"].to_pylist(), batch["name_no"].to_pylist(), batch["item_no"].to_pylist(), strict=True)):
            if r != report:
                report, name, taken = r, None, set()
            if n != name:
                name, served = n, False
            if not served and item not in taken:
                taken.add(item)
                served = True
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def reconciled(missing: DataFrame, extra: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Missing names and extra items that name the same, one to one: what is matched so, and what stays missing and extra.

    missing: (report_id, category, name, rule_pos, …); extra: (report_id, category, item, pos); pairs: (category, report_name, item_name). Lists that the
    same pairs made have nothing left to match; lists from elsewhere (stored reports, other rule books, an earlier round of names) do.
    """
    met = missing.join(pairs.select("category", F.col("item_name").alias("name"), F.col("report_name").alias("item")), ["category", "name"])
    found = one_to_one(met.join(extra.select("report_id", "item", "pos"), ["report_id", "item"]))
    return {
        "matched": found.withColumn("match_type", F.lit("synonym")),
        "missing": missing.join(found.select("report_id", "name"), ["report_id", "name"], "left_anti"),
        "extra": extra.join(found.select("report_id", "item"), ["report_id", "item"], "left_anti"),
    }


# --- methods and bases --------------------------------------------------------------------------

def method_issues(matched: DataFrame) -> DataFrame:
    """Matched items whose reported method does not satisfy the required one.

    The comparison runs on distinct (reported, required) methods.
    """
    reported = without_blanks(F.coalesce(F.col("report_method"), F.lit("")))
    compared = matched.select("report_method", "required_method").where((F.col("report_method") != "") & (F.col("required_method") != "")).distinct()
    wrong = (reported != "") & ~codes.method_matches(reported, "required_method")
    told = stored_few(matched.sparkSession, compared.withColumn("wrong", wrong), "methods")
    return matched.join(told, ["report_method", "required_method"]).where("wrong").select(
        "report_id", F.col("name").alias("item"), F.col("required_method").alias("expected"),
        F.col("report_method").alias("actual"), "rule_pos", F.lit("检测方法不一致").alias("issue"),
    )


def satisfied_bases(cited: DataFrame, rules: DataFrame) -> DataFrame:
    """(report_id, required_basis) satisfied by some cited code; cited: (report_id, category, code).

    The comparison runs on distinct (code, basis) of all categories.
    """
    spark = cited.sparkSession
    bases = rules.select("category", F.col("standard_basis").alias("required_basis")).where("required_basis <> ''").distinct()
    known = stored(spark, cited.select("category", "code").distinct(), "codes").join(stored_few(spark, bases, "bases"), "category")
    compared = stored(spark, known.select("code", "required_basis").distinct(), "compared")
    good = stored_few(spark, compared.where(codes.method_matches("code", "required_basis")), "good")
    per_category = stored_few(spark, known.join(good, ["code", "required_basis"]), "good")
    return by_report(cited.join(per_category, ["category", "code"]).select("report_id", "required_basis")).distinct()


def basis_issues(matched: DataFrame, satisfied: DataFrame) -> DataFrame:
    """Matched items whose required basis is cited nowhere in the report."""
    open_ = matched.where((F.coalesce("required_basis", F.lit("")) != "") & ~codes.basis_exempt("required_basis"))
    return open_.join(satisfied, ["report_id", "required_basis"], "left_anti").select(
        "report_id", F.col("name").alias("item"), F.col("required_basis").alias("expected"), "rule_pos",
        F.lit("判定依据未在报告中引用").alias("issue"),
    )


def method_flags(matched: DataFrame, issues: DataFrame) -> DataFrame:
    """Matched items with a flag for a method issue."""
    marked = issues.select("report_id", F.col("item").alias("name"), F.lit(True).alias("hit")).distinct()
    return matched.join(marked, ["report_id", "name"], "left").withColumn(
        "has_issue", F.coalesce("hit", F.lit(False))
    ).drop("hit")
