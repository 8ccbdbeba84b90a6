"""Matches per report stay in one deal by report; results equal a walk through the rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millaudit.operators import matching, review
from millaudit.session import by_report

ITEMS = "report_id long, category string, item string, pos int, method string"
RULES = "category string, item_name string, pos int, condition string, standard_basis string, test_method string, source_page int"


def rules_of(category, names):
    return [(category, n, i, "限甲" if i % 3 == 0 else "", f"GB {i}", "GB 5009.1", i) for i, n in enumerate(names)]


@pytest.fixture(scope="module")
def book(spark):
    names = [f"项目甲{a}{b}" for a in "铅铜锌铁锰铬镍钴" for b in "酸酯醇胺酮醛烷烯炔醚"]
    rules = rules_of("A", names) + rules_of("B", names[:70])
    draw = random.Random(5)
    items = [
        (r, "A" if r % 2 else "B", draw.choice(names), p, draw.choice(["GB 5009.1-2016", "GB/T 7", ""])) for r in range(30) for p in range(draw.randint(1, 40))
    ]
    return spark.createDataFrame(items, ITEMS), spark.createDataFrame(rules, RULES), items, rules


def found_of(items, rules):
    known = matching.name_pairs(items.select("category", F.col("item").alias("report_name")), rules)
    return matching.matched_items(matching.last_items(items), rules, known)


def test_rows_are_dealt_by_report_once(spark, book):
    """No list of matches is dealt anew by its names: every exchange of the plan is the one by report."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = found_of(book[0], book[1])
        flags = matching.method_flags(found, matching.method_issues(found))
        plan = flags._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all(re.fullmatch(r"report_id#\d+L?, \d+", d) for d in dealt), dealt


def test_unmatched_rules_over_several_words_of_bits(spark, book):
    """More than 64 rules a category, a report twice, a report in two categories, and one without matches."""
    items, rules, given, _ = book
    found = found_of(items, rules)
    asked = [(r, "A" if r % 2 else "B") for r in range(30)] + [(1, "A"), (2, "A"), (99, "B"), (None, "B")]
    got = sorted(
        ((-1 if r.report_id is None else r.report_id, r.category, r["name"], r.kind) for r in matching.unmatched_rules(spark.createDataFrame(asked, "report_id long, category string"), rules, found).collect())
    )
    ruled, named = {(k, name) for k, name, *_ in book[3]}, {}
    for r, c, item, _, _ in given:
        if (c, item) in ruled:
            named.setdefault(r, set()).add(item)
    want = sorted(
        (-1 if r is None else r, c, name, "conditional" if condition else "missing")
        for r, c in asked for k, name, _, condition, *_ in book[3] if k == c and name not in named.get(r, ())
    )
    assert got == want


def test_fields_never_decide_a_match(spark, book):
    items, rules, *_ = book
    full, narrow = found_of(items, rules), found_of(items.drop("method"), rules)
    assert "report_method" not in narrow.columns
    keys = ["report_id", "name", "report_name", "match_type"]
    assert sorted(map(tuple, full.select(keys).collect())) == sorted(map(tuple, narrow.select(keys).collect()))


def test_one_to_one_is_one_scan(spark):
    """Chains that gave one name a round are a single job without a join."""
    rows = [(r, f"n{i}", i, f"i{j}", j) for r in (1, 2) for i in range(12) for j in range(i + 1)]
    taken = matching.one_to_one(spark.createDataFrame(rows, "report_id long, name string, rule_pos int, item string, pos int"))
    assert "Join" not in taken._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, taken.collect())) == sorted((r, f"n{i}", f"i{i}") for r in (1, 2) for i in range(12))


def test_extra_items_meet_missing_names(spark):
    missing = spark.createDataFrame([(1, "A", "铅"), (2, "B", "铅"), (3, "A", "铜")], "report_id long, category string, name string")
    extra = spark.createDataFrame([(1, "A", "总铅"), (2, "B", "总铅"), (3, "A", "总铅")], "report_id long, category string, item string")
    known = spark.createDataFrame([("A", "总铅", "铅", "fuzzy")], "category string, report_name string, item_name string, match_type string")
    assert [tuple(r) for r in matching.synonym_items(missing, extra, known).collect()] == [(1, "铅", "总铅")]


def test_section_numbers_and_summary_of_dealt_lists(spark):
    lists = spark.createDataFrame(
        [(1, "matched", "a", 3), (1, "missing", "b", 1), (1, "conditional", "c", 2), (1, "extra", "d", 0), (1, "matched", "e", 7), (2, "conditional", "c", 5)],
        "report_id long, kind string, name string, pos int",
    )
    numbers = {(r.report_id, r["name"]): r.no for r in review.numbered_sections(by_report(lists), 2).collect()}
    assert numbers == {(1, "a"): 1, (1, "e"): 2, (1, "b"): 3, (1, "c"): 4, (1, "d"): 5, (2, "c"): 1}
    choices = spark.createDataFrame([(1, "c", "condition_met"), (1, "a", "rejected")], "report_id long, key string, decision string")
    summary = {r.report_id: (r.n_required, r.n_matched, r.n_rejected, r.n_open, r.n_extra) for r in review.item_summary(lists, choices).collect()}
    assert summary == {1: (4, 3, 0, 0, 1), 2: (1, 0, 0, 1, 0)}
    plan = review.item_summary(lists, choices)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
