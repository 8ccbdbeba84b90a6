"""Literal cases of the column library, run through small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from millaudit.functions import codes, dates, html, labels, numbers as N, text as T
from millaudit.operators import retrieval, rule_tables, standards


def value(spark, make, *texts):
    """Value of an expression over one row of texts."""
    names = [f"c{i}" for i in range(len(texts))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([tuple(texts)], schema).select(make(*names).alias("v")).collect()[0]["v"]


def test_name_core(spark):
    assert value(spark, T.name_core, "克百威(克百威及3-羟基克百威之和，以克百威表示)") == "克百威"
    assert value(spark, T.name_core, " 维生素　A（视黄醇） ") == "维生素A"


@pytest.mark.parametrize(
    "name, parts",
    [
        ("甲拌磷和克百威", ["甲拌磷", "克百威"]),
        ("阿维菌素哒螨灵", ["阿维菌素哒螨灵"]),
        ("伊维菌素阿维菌素哒螨灵", ["伊维菌素", "阿维菌素"]),
        ("铅", ["铅"]),
        ("亚油酸与亚麻酸比值甲乙/钙磷比值", ["亚油酸与亚麻酸比值甲乙/钙磷比值"]),
        ("甲拌磷、克百威、乐果", ["甲拌磷", "克百威", "乐果"]),
    ],
)
def test_name_parts(spark, name, parts):
    assert value(spark, T.name_parts, name) == parts


def test_cells(spark):
    assert value(spark, T.repaired_cell, "维生素K\n1") == "维生素K1"
    assert value(spark, T.repaired_cell, "硝酸盐(以NaNO 计)\n3") == "硝酸盐(以NaNO3计)"
    assert value(spark, T.without_bracket_blanks, "甜蜜素（以环己 基氨基磺酸计） 甲") == "甜蜜素（以环己基氨基磺酸计） 甲"
    assert value(spark, rule_tables.split_cell_items, "亚硝酸盐（以NaNO2计）e 黄曲霉毒素M1 或黄曲霉 51 毒素B1") == [
        "亚硝酸盐（以NaNO2计）", "黄曲霉毒素M1 或黄曲霉 毒素B1",
    ]
    assert value(spark, T.food_lines, "1. 苹果\n\n - 梨 \n") == ["苹果", "梨"]
    assert [tuple(x) for x in value(spark, T.indent_levels, "甲\n  乙")] == [("甲", 0, 0), ("乙", 0, 0)]


def test_codes(spark):
    assert value(spark, codes.report_codes, "GB 2763-2021、GB/T 5009.12-2017、GB/Z 26578") == [
        "GB 2763-2021", "GB/T 5009.12-2017", "GB/Z 26578",
    ]
    assert value(spark, codes.standard_number, "GB 23200.113- 2018") == "23200.113-2018"
    assert value(spark, codes.standard_number_short, "GB 5009.33-2016") == "33-2016"
    assert value(spark, codes.required_method_tokens, "GB 5009.87 第二法、第三法 GB/T 1 自检") == [
        "GB 5009.87 第二法、第三法", "GB/T 1", "自检",
    ]


@pytest.mark.parametrize(
    "reported, required, good",
    [
        ("GB 5009.87-2016 第二法", "GB 5009.87 第二法、第三法", True),
        ("GB 5009.5-2016 第三法", "GB 5009.5 第一法", False),
        ("GB 5009.87 第三法", "GB 5009.5 第一法 GB 5009.87 第三法", True),
        ("GB 5009.5 第三法", "GB 5009.5 第一法 GB 5009.87 第三法", False),
        ("企业方法A", "方法A", True),
        ("GB/T 5009.5", "GB 5009.5", False),
    ],
)
def test_method_matches(spark, reported, required, good):
    assert value(spark, codes.method_matches, reported, required) is good


@pytest.mark.parametrize(
    "text, number", [("0.052", 0.052), ("<0.01", 0.0), ("未检出", 0.0), ("ND", 0.0), ("", None), ("约1.5mg", 1.5), ("..", None)]
)
def test_measured_value(spark, text, number):
    assert value(spark, N.measured_value, text) == number


def test_review_value_differs(spark):
    assert value(spark, N.review_number, "<0.01") == 0.01
    assert value(spark, N.review_number, "1.2:1") is None
    assert value(spark, N.review_number, "未检出(定量限:0.01)") == 0


def test_plans_and_samples(spark):
    assert tuple(value(spark, N.sampling_plan, "n=5, c=2, m=1000, M=10000")) == (5, 2, 1000.0, 10000.0)
    assert value(spark, N.sampling_plan, "n=5,c=0,m=0") is None
    assert tuple(value(spark, N.review_plan, "n=5,c=0,m=0")) == (5, 0, 0.0, None)
    assert value(spark, N.sample_values, "<10,<10,<10,<10,<10") == [0.0] * 5
    assert value(spark, N.sample_values, "12") is None
    assert value(spark, N.sample_values, "1、2") == [1.0, 2.0]
    assert value(spark, N.review_samples, "1、2") is None


@pytest.mark.parametrize(
    "text, bounds",
    [("≤0.5", (None, 0.5)), ("≥12", (12.0, None)), ("0.07～0.33", (0.07, 0.33)), ("N.S.a~20", (None, 20.0)), ("12~N.S.", (12.0, None)), ("1.2:1~2:1", None), ("25", None), ("–", None)],
)
def test_review_range(spark, text, bounds):
    found = value(spark, N.review_range, text)
    assert (tuple(found) if found else None) == bounds


def test_dates(spark):
    assert value(spark, dates.flexible_date, "2025.5.6") == datetime.date(2025, 5, 6)
    assert value(spark, dates.flexible_date, "2025年5月6日") is None
    assert value(spark, dates.flexible_date, "2025-13-6") is None
    assert value(spark, lambda c: dates.flexible_date(c, strict=False), "2025年5月6日") == datetime.date(2025, 5, 6)


def test_categories(spark):
    assert value(spark, retrieval.food_categories, "黄瓜") == ["瓜类蔬菜", "黄瓜", "蔬菜"]
    assert value(spark, retrieval.food_categories, "星飞帆幼儿配方奶粉3段") == ["幼儿配方食品", "幼儿配方乳粉", "婴幼儿配方食品"]
    assert value(spark, retrieval.food_categories, "某物") == ["某物"]


@pytest.mark.parametrize("status, good", [("现行有效", True), ("部分有效", False), ("即将实施", False), ("已废止", False), ("", False), (None, False)])
def test_in_force(spark, status, good):
    assert value(spark, standards.in_force, status) is good


def test_labels(spark):
    text = "产品类型：\n 纯牛奶！\n产品标准代号：GB25190\n生产日期：2024年1月15日\n保质期：6 个月以上"
    assert value(spark, labels.product_type, text) == "纯牛奶"
    assert value(spark, labels.standard_code, text) == "GB 25190"
    assert value(spark, dates.label_date, text) == "2024-1-15"


def test_number_text(spark):
    row = spark.range(1).select(*[T.number_text(F.lit(x)).alias(n) for n, x in [("a", 10000000.0), ("b", 0.5), ("c", 0.0005)]]).collect()[0]
    assert tuple(row) == ("10000000.0", "0.5", "0.0005")


def test_section_table(spark):
    rows = retrieval.section_table(spark).collect()
    assert len(rows) == 39 and rows[0]["members"][0] == "小麦粉"


def test_no_table_gives_no_rows(spark):
    d = spark.createDataFrame([(1, "没有表格"), (2, None)], "k int, content string")
    assert rule_tables.html_rows(d).count() == 0
    assert value(spark, html.status_from_text, "废止日期：无") == "已废止"
