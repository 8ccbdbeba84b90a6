"""Operators against brute force and invariants on small tables."""

import random

from pyspark.sql import functions as F

from millaudit.functions import text as T
from millaudit.operators import matching, page_tables, retrieval, rule_tables, standards
from millaudit.sources.store import VerdictStore
from millaudit.streaming import jobs


def names(seed, n):
    rng = random.Random(seed)
    pieces = ["铅", "维生素", "B1", "B12", "甲拌磷", "克百威", "乳糖", "占", "碳水化合物", "含量", "总量", "和", "、", "比例", "比值", "（以X计）", "A" * 40]
    return sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(n)})


def test_name_pairs_equal_all_pairs(spark):
    """Key joins give the same pairs as comparing every name with every other."""
    a, b = names(1, 90), names(2, 90)
    left = spark.createDataFrame([("c", x) for x in a], "category string, report_name string")
    right = spark.createDataFrame([("c", x) for x in b], "category string, item_name string")
    got = {(r.report_name, r.item_name, r.match_type) for r in matching.name_pairs(left, right).collect()}

    def forms(df, name):
        rows = df.select(name, T.name_core(name).alias("core")).select(
            name, "core", T.is_composite("core").alias("comp"), T.composite_synonym("core").alias("syn"), T.name_parts("core").alias("parts")
        )
        return [tuple(r) for r in rows.collect()]

    def contained(x, y):
        short, long = (x, y) if len(x) <= len(y) else (y, x)
        if len(short) < 3 or short not in long:
            return False
        after = long[long.find(short) + len(short):][:1]
        return not (after.isdigit() or (after.isascii() and after.isalpha()))

    want = set()
    for name, core, comp, syn, parts in forms(left, "report_name"):
        for name2, core2, comp2, syn2, parts2 in forms(right, "item_name"):
            if core == core2:
                want.add((name, name2, "exact"))
            elif comp or comp2:
                if syn == syn2:
                    want.add((name, name2, "fuzzy"))
            elif contained(core, core2) or any(p == q or contained(p, q) for p in parts for q in parts2):
                want.add((name, name2, "fuzzy"))
    assert got == want and len(want) > 50


def test_first_match_wins_over_exact(spark):
    """A fuzzy match earlier in the report beats an exact one later; blank cores match each other."""
    items = spark.createDataFrame(
        [("r", "c", "蛋白质含量", 1, "", "", "1", "m1"), ("r", "c", "蛋白质", 2, "", "", "2", "m2"), ("r", "c", "（空）", 3, "", "", "3", "")],
        "report_id string, category string, item string, pos int, unit string, standard string, value string, method string",
    )
    rules = spark.createDataFrame(
        [("c", "蛋白质", 1, "", "", "", 1), ("c", "（无）", 2, "", "", "", 1), ("c", "脂肪", 3, "限甲", "", "", 1)],
        "category string, item_name string, pos int, condition string, standard_basis string, test_method string, source_page int",
    )
    pairs = matching.name_pairs(items.select("category", F.col("item").alias("report_name")), rules)
    found = {r["name"]: (r["report_name"], r["match_type"]) for r in matching.matched_items(matching.last_items(items), rules, pairs).collect()}
    assert found == {"蛋白质": ("蛋白质含量", "fuzzy"), "（无）": ("（空）", "exact")}


def test_section_rows_equal_scan(spark):
    """Section state by running sums equals a row by row scan."""
    rng = random.Random(5)
    headings = ["水果", "蔬菜", "谷物"]
    rows, want = [], {}
    for doc in range(30):
        open_ = False
        for t in range(12):
            stopped = False
            for r in range(rng.randint(0, 5)):
                name = rng.choice(headings + ["苹果", "青苹果", "梨"])
                value = rng.choice(["", "1", "2", "3"])
                rows.append((doc, t, r, [name, value]))
                if stopped:
                    continue
                if name == "水果":
                    open_ = True
                elif open_ and name in headings:
                    open_, stopped = False, True
                elif open_ and value and "苹果" in name:
                    want[(doc, name)] = value
    df = spark.createDataFrame(rows, "doc_id int, table_no int, row_no int, cells array<string>")
    got = {(r.doc_id, r.name): r.value for r in page_tables.rows_of_section(df, "水果", ["苹果"], headings, tables_per_block=4).collect()}
    assert got == want and len(want) > 10


def test_clustered_rows_in_blocks(spark):
    """Rows found on tiles and in small blocks equal a scan over sorted boxes."""
    rng = random.Random(3)
    boxes = [(1, 1, float(rng.randint(0, 500)), rng.randint(0, 16000) / 4.0, i) for i in range(400)]
    df = spark.createDataFrame(boxes, "doc_id int, page int, x double, y double, k int")
    got = {r.k: r.row_no for r in page_tables.clustered_rows(df, 25.0, tiles_per_block=3).collect()}
    row, last, want = 0, None, {}
    for box in sorted(boxes, key=lambda b: b[3]):
        if last is None or box[3] - last >= 25:
            row += 1
        last = box[3]
        want[box[4]] = row
    assert got == want


def test_nearest_chunks_in_blocks(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    chunks = spark.createDataFrame(vectors, "chunk_id int, vector array<double>")
    questions = spark.createDataFrame(vectors[:15], "question_id int, vector array<double>")
    got = {(r.question_id, r.rank): r.chunk_id for r in retrieval.nearest_chunks(questions, chunks, 5, blocks=4, groups=3, tile=7).collect()}
    unit = [[x / sum(y * y for y in v) ** 0.5 for x in v] for _, v in vectors]
    for q in range(15):
        score = lambda i: round(sum(a * b for a, b in zip(unit[q], unit[i])), 9)  # noqa: B023, E731
        assert [got[(q, r)] for r in range(1, 6)] == sorted(range(120), key=lambda i: (-score(i), i))[:5]


def test_rule_items_of_a_question(spark):
    """A footnote of an earlier chunk is seen by later ones and not the other way round."""
    def content(item, note):
        return f"<table><tr><th>检验项目</th><th>检测方法</th></tr><tr><td>{item}b</td><td>GB 1</td></tr><tr><td>{note}</td><td></td></tr></table>"

    rows = [("q", 1, content("蛋白质", "a. 甲")), ("q", 2, content("乳脂肪", "b. 限乙类产品")), ("q", 3, content("水分含量", "c. 丙"))]
    d = spark.createDataFrame(rows, "question_id string, chunk_rank int, content string")
    got = {r.item_name: r.condition for r in rule_tables.question_items(d).collect()}
    assert got == {"蛋白质": "", "乳脂肪": "限乙类产品", "水分含量": "限乙类产品"}


def test_stored_verdicts_stay_for_a_day(spark, tmp_path):
    """Second run on the same day has no misses; errors are asked again after an hour."""
    registry = spark.createDataFrame(
        [("GB 2763-2021", "2021-03-03", "2021-09-03", None, "已废止", "u")],
        "code string, publish_date string, implement_date string, abolish_date string, status string, detail_url string",
    )
    requests = spark.createDataFrame([("GB 2763-2021", "2025-05-26"), ("GB 1", "2025-05-26")] * 3, "code string, production_date string")
    schema = "code string, production_date string, passed boolean, status string, status_text string, publish_date string, implement_date string, abolish_date string, detail_url string, reasons array<string>, error string, ts double"
    store = VerdictStore(spark, str(tmp_path / "store"), schema)
    assert store.read().count() == 0
    results, after = standards.validated(requests, registry, store.read(), 1_000_000.0)
    rows = {r.code: r for r in results.collect()}
    assert rows["GB 2763-2021"].status == "obsolete" and rows["GB 2763-2021"].reasons == ["标准状态不是现行有效（当前为：已废止）"]
    assert rows["GB 1"].status == "error"
    store.write(after)
    assert standards.cache_misses(requests, store.read(), 1_000_100.0).count() == 0
    assert [r.code for r in standards.cache_misses(requests, store.read(), 1_003_700.0).collect()] == ["GB 1"]
    assert standards.cache_misses(requests, store.read(), 1_090_000.0).count() == 2


def test_verdict_stream_batch_by_batch(spark, tmp_path):
    """Batches of a stream answer like the batch job at the same times."""
    registry = spark.createDataFrame(
        [("GB 5", "2001-01-01", "2001-02-01", None, "现行有效", "u")],
        "code string, publish_date string, implement_date string, abolish_date string, status string, detail_url string",
    )
    schema = "code string, production_date string, passed boolean, status string, status_text string, publish_date string, implement_date string, abolish_date string, detail_url string, reasons array<string>, error string, ts double"
    source = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([("GB 5", "2020-01-01"), ("GB 7", f"2020-01-0{i + 1}")], "code string, production_date string").coalesce(1).write.mode("append").parquet(source)
    store = VerdictStore(spark, str(tmp_path / "store"), schema)
    stream = spark.readStream.schema("code string, production_date string").option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    jobs.run_verdict_reuse(spark, stream, registry, store, lambda b: 1e6 + 100_000.0 * b, out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 6 and store.version() == 3
    # A day lies between the batches, so the known code is judged anew in each.
    assert sorted(r.ts for r in rows if r.code == "GB 5") == [1e6, 1.1e6, 1.2e6]


def test_plans_hold_no_nested_loops(spark):
    """Joins of tables are equi-joins, and rank filters cut rows before the shuffle."""
    from millaudit.plans import queries_items as Q, queries_retrieval as QR

    sf = "/root/testdata/sf0.001"
    for df in [Q.matched(spark, sf), QR.top_chunks(spark, sf)]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert "WindowGroupLimit" in QR.top_chunks(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_frequent_words_still_give_hits(spark):
    from millaudit.operators import retrieval

    chunks = spark.range(2000).selectExpr("cast(id as string) as chunk_id", "'铅 限量' as content")
    question = spark.createDataFrame([("1", "铅 限量")], "question_id string, question string")
    assert retrieval.top_chunks(question, chunks, lambda c: retrieval.char_grams(c, 2), 20).count() == 20


def test_the_hot_gram_plan_never_changes_hits(spark):
    """Against brute force, with every gram, some grams and no gram treated as frequent."""
    from millaudit.operators import retrieval

    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("aaaabbbccdefgh") for _ in range(n))
    held = [(i, words(rng.randint(1, 6))) for i in range(60)]
    asked = [(i, words(rng.randint(1, 4))) for i in range(12)]
    want = {}
    for q, text in asked:
        grams = set(text.split())
        scored = sorted((-len(grams & set(t.split())) / len(grams), c) for c, t in held if grams & set(t.split()))
        want[q] = [c for _, c in scored[:5]]
    chunks, questions = spark.createDataFrame(held, "chunk_id int, content string"), spark.createDataFrame(asked, "question_id int, question string")
    for hot in (0, 15, 1000):
        got = {q: {} for q in want}
        for r in retrieval.top_chunks(questions, chunks, lambda c: retrieval.word_grams(c, 1), 5, hot=hot).collect():
            got[r.question_id][r["rank"]] = r.chunk_id
        assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == want


def test_a_repeated_batch_reads_the_same_store(spark, tmp_path):
    from millaudit.sources.store import VerdictStore

    store = VerdictStore(spark, str(tmp_path / "store"), "code string, ts double")
    assert store.read().count() == 0
    store.write(spark.createDataFrame([("GB 1", 1.0)], "code string, ts double"))
    store.write(store.read(below=1).selectExpr("code", "ts + 1 AS ts"), 1)
    store.write(store.read(below=1).selectExpr("code", "ts + 1 AS ts"), 1)
    assert [r.ts for r in store.read().collect()] == [2.0] and store.version() == 1
    (tmp_path / "store" / "v=2").mkdir()
    (tmp_path / "store" / "v=2" / "part-0.parquet").write_bytes(b"no parquet")
    (tmp_path / "store" / "v=2" / "_SUCCESS").touch()
    assert store.read().count() == 0


def test_one_registry_row_and_one_decision_count(spark):
    from pyspark.sql import functions as F

    from millaudit.operators import review, standards

    registry = spark.createDataFrame(
        [("GB/T 2001-2016", None, "2016-06-01", "2020-01-01", "已废止", "u"), ("GB 2001-2016", None, "2016-06-01", None, "现行有效", "v")],
        "code string, publish_date string, implement_date string, abolish_date string, status string, detail_url string",
    )
    asked = spark.createDataFrame([("GB 2001-2016", "2021-05-05")], "code string, production_date string")
    assert [(r.passed, r.status) for r in standards.verdicts(asked, registry).collect()] == [(True, "valid")]
    rows = spark.createDataFrame([("r", "k")], "report_id string, k string")
    told = spark.createDataFrame([("r", "k", "pass", 1), ("r", "k", "fail", 2)], "report_id string, key string, decision string, place int")
    assert [r.decision for r in review.decided(rows, told, F.col("k")).collect()] == ["fail"]


def test_all_character_references(spark):
    from millaudit.functions import html

    rows = spark.createDataFrame([("&#8804;0.5 &deg; &#x3BC;g &Omega; &amp;lt; a&b &nope; &#0; x&",)], "t string")
    assert rows.select(html.unescaped("t").alias("x")).first().x == "≤0.5 ° μg Ω &lt; a&b &nope; &#0; x&"


def test_chains_of_several_tables_on_a_page(spark):
    from millaudit.operators import page_tables

    cells = [(1, p, t, r, [f"{p}{t}{r}"]) for p in (1, 2, 3) for t in (0, 1) for r in (0, 1)]
    rows = spark.createDataFrame(cells, "doc_id int, page int, table_no int, row_no int, cells array<string>")
    pairs = spark.createDataFrame([(1, 1, 1, 0), (1, 2, 0, 1)], "doc_id int, page int, table_no int, next_table_no int")
    got = {}
    for r in page_tables.chained_tables(rows, pairs).collect():
        got.setdefault(r.chain_no, set()).add(r.cells[0])
    assert got == {1: {"100", "101"}, 2: {"110", "111", "201", "311"}, 3: {"210", "211"}, 4: {"300", "301"}}
