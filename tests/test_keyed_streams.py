"""Keyed tables as logs, verdict reuse as keyed state, merged reports, one-to-one matching, long item scans."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from millaudit.operators import matching, rule_tables
from millaudit.sources.keyed import KeyedTable
from millaudit.streaming import reports as merged, reuse

DAY = 86_400 * reuse.SECOND


def rows_of(table, below=None):
    return sorted(tuple(r) for r in table.read(below).collect())


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_keyed_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    t = KeyedTable(spark, folder, ["k"], "k bigint, place int, v string", buckets=8)
    assert rows_of(t) == [] and t.versions() == []

    def frame(rows):
        return spark.createDataFrame(rows, "k bigint, place int, v string")

    first = [(k, p, f"a{k}") for k in range(2000) for p in range(2)]
    t.write(frame(first), 0)
    assert rows_of(t) == sorted(first)
    # A key's new rows replace all it had; a gone key loses its rows; other keys keep theirs.
    t.write(frame([(3, 0, "b3")]), 1, gone=spark.createDataFrame([(3,), (4,)], "k bigint"))
    now = sorted([r for r in first if r[0] not in (3, 4)] + [(3, 0, "b3")])
    assert rows_of(t) == now and rows_of(t, below=1) == sorted(first)
    # A write costs its own keys, not the table.
    assert size_of(f"{folder}/data/v=1") * 5 < size_of(f"{folder}/data/v=0")
    # A repeated version changes nothing.
    t.write(frame([(3, 0, "other")]), 1)
    assert rows_of(t) == now
    # Without its manifest a version is not there, and writing it again replaces what was left of it.
    t._store(t._bucketed(frame([(5, 9, "half")]).withColumn("_alive", F.lit(True))), 2)
    assert rows_of(t) == now
    t.write(frame([(4, 1, "back")]), 2)
    now = sorted(now + [(4, 1, "back")])
    assert rows_of(t) == now
    before = t.manifest()
    t.compact(3)
    assert rows_of(t) == now and all(len(v) == 1 for v in t.manifest().values())
    assert {b for b, v in before.items() if len(v) == 1} == {b for b, v in t.manifest().items() if v == [0]}
    t.write(frame([(k, 0, "c") for k in range(2000)]), 4)
    t.compact(5)
    assert t.vacuum(keep=1) == [0, 1, 2, 3, 4] and rows_of(t) == [(k, 0, "c") for k in range(2000)]


def test_table_without_keys_is_empty_again(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k string, v array<string>", buckets=2)
    t.write(spark.createDataFrame([("a", ["x"])], t.schema), 0)
    t.write(spark.createDataFrame([], t.schema), 1, gone=spark.createDataFrame([("a",), ("b",)], "k string"))
    assert rows_of(t) == []
    t.compact(2)
    assert rows_of(t) == [] and all(len(v) == 1 for v in t.manifest().values())


def arriving(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are read by their age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


REGISTRY = "code string, publish_date string, implement_date string, abolish_date string, status string, detail_url string"


def test_verdicts_expire_inside_a_run_and_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    registry = spark.createDataFrame([("GB 1-2016", "2015-01-01", "2016-01-01", None, "现行有效", "u")], REGISTRY)
    schema = "code string, production_date string, asked bigint"
    good, bad, day = "GB 1-2016", "GB 9", "2020-01-01"
    batches = [
        [(good, day, 0), (good, day, 5), (bad, day, 0)],
        [(good, day, DAY - 1), (bad, day, DAY // 48)],
        [(good, day, DAY), (good, day, DAY + 1), (bad, day, DAY // 24)],  # a day later judged anew; an error lives for an hour
    ]
    known = spark.createDataFrame([("GB 7", day, -5, True, "valid", "", None, None, None, None, [], None)], reuse.ANSWERS.replace("answered bigint, ", ""))
    reuse.run_reuse(arriving(spark, folder, batches, schema), registry, known, out, checkpoint).awaitTermination()

    def answers():
        found = spark.read.parquet(out).groupBy("code", "judged_at", "status").agg(F.sum("answered").alias("n"))
        return sorted((r.code, r.judged_at, r.status, r.n) for r in found.collect())

    first = [(good, 0, "valid", 3), (good, DAY, "valid", 2), (bad, 0, "error", 2), (bad, DAY // 24, "error", 1)]
    assert answers() == sorted(first)
    # Three batches asked for one key, two verdicts; after a restart the state goes on, and verdicts from before the stream count.
    more = [[(good, day, 2 * DAY - 1), ("GB 7", day, 10), ("GB 7", day, DAY)]]
    reuse.run_reuse(arriving(spark, folder, more, schema), registry, known, out, checkpoint).awaitTermination()
    first[1] = (good, DAY, "valid", 3)
    assert answers() == sorted([*first, ("GB 7", -5, "valid", 1), ("GB 7", DAY, "error", 1)])
    last = {r.code: r.judged_at for r in reuse.latest(spark.read.parquet(out)).collect()}
    assert last == {good: DAY, bad: DAY // 24, "GB 7": DAY}


PAGES = "report_id bigint, version int, page int, text_lines array<string>, tables array<array<array<string>>>"


def counted(pages):
    """A small stand-in for an audit: lines and pages per report, every line with its report."""
    lines = pages.select("report_id", "page", F.explode("text_lines").alias("line"))
    summary = pages.groupBy("report_id").agg(F.count("*").alias("pages"), F.sum(F.size("text_lines")).alias("lines"))
    return {"summary": summary, "issues": lines.where("line like 'bad%'")}


def test_reports_merge_over_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    batches = [
        [(1, 0, 1, ["a", "bad 1"], []), (2, 0, 1, ["bad 2"], []), (3, 1, 1, ["x"], [])],
        [(1, 0, 2, ["b"], []), (3, 0, 1, ["old", "bad old"], []), (3, 0, 2, ["old"], [])],  # the second page of 1; an older version of 3 changes nothing
        [(2, 1, 1, ["c", "d"], []), (1, 0, 2, ["b"], [])],  # a later version of 2 in place of the first; a page that came before
    ]
    kept = merged.AuditedReports(spark, str(tmp_path / "out"), ("summary", "issues"), buckets=4)
    assert kept.read("summary") is None
    stream = arriving(spark, folder, batches, PAGES)
    merged.run_audits(stream, counted, kept, str(tmp_path / "state")).awaitTermination()
    want = [(1, 2, 3), (2, 1, 2), (3, 1, 1)]
    assert sorted(tuple(r) for r in kept.read("summary").collect()) == want
    assert [tuple(r) for r in kept.read("issues").collect()] == [(1, 1, "bad 1")]
    # A batch that runs again changes nothing, and a batch that failed between two tables is not seen by readers.
    kept.merge(spark.createDataFrame([(9, 0, 1, ["bad"], [])], PAGES), 2, counted)
    assert sorted(tuple(r) for r in kept.read("summary").collect()) == want

    def broken(pages):
        return {"summary": counted(pages)["summary"]}

    with pytest.raises(KeyError):
        kept.merge(spark.createDataFrame([(1, 5, 1, ["new"], [])], PAGES), 3, broken)
    assert sorted(tuple(r) for r in kept.read("summary").collect()) == want
    kept.merge(spark.createDataFrame([(1, 5, 1, ["new"], [])], PAGES), 3, counted)
    assert sorted(tuple(r) for r in kept.read("summary").collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)] and kept.read("issues").isEmpty()
    kept.compact(4)
    assert sorted(tuple(r) for r in kept.read("summary").collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_one_to_one_goes_through_the_names_in_order(spark):
    rng = random.Random(4)
    rows = [(r, f"n{n}", n // 2, f"i{i}", i // 2) for r in range(40) for n in range(rng.randint(0, 8)) for i in range(8) if rng.random() < 0.4]
    rows += [(99, f"n{n}", n, f"i{i}", i) for n in range(6) for i in (n - 1, n) if i >= 0]  # a chain: each choice waits for the one before
    schema = "report_id bigint, name string, rule_pos int, item string, pos int"
    got = sorted(tuple(r) for r in matching.one_to_one(spark.createDataFrame(rows, schema)).collect())
    want = []
    for r in {x[0] for x in rows}:
        used = set()
        for _, name in sorted({(x[2], x[1]) for x in rows if x[0] == r}):
            free = sorted((x[4], x[3]) for x in rows if x[0] == r and x[1] == name and x[3] not in used)
            if free:
                used.add(free[0][1])
                want.append((r, name, free[0][1]))
    assert got == sorted(want)
    assert matching.one_to_one(spark.createDataFrame([], schema)).collect() == []


def test_reconciled_lists(spark):
    missing = spark.createDataFrame([(1, "c", "铅含量", 1), (1, "c", "镉", 2)], "report_id int, category string, name string, rule_pos int")
    extra = spark.createDataFrame([(1, "c", "铅总量", 1), (1, "c", "汞", 2)], "report_id int, category string, item string, pos int")
    pairs = spark.createDataFrame([("c", "铅总量", "铅含量")], "category string, report_name string, item_name string")
    out = matching.reconciled(missing, extra, pairs)
    assert [tuple(r) for r in out["matched"].collect()] == [(1, "铅含量", "铅总量", "synonym")]
    assert [r.name for r in out["missing"].collect()] == ["镉"] and [r["item"] for r in out["extra"].collect()] == ["汞"]


def test_item_scan_is_linear(spark):
    def table(n):
        rows = "".join(f"<tr><td>指标{i}（以某</td><td>GB 1</td></tr><tr><td>计）</td><td></td></tr><tr><td>限腌制产品</td><td></td></tr>" for i in range(n))
        return f"<table><tr><th>检验项目</th><th>依据法律法规或标准</th></tr>{rows}</table>"

    def run(n):
        chunks = spark.createDataFrame([(1, table(n))], "chunk_id int, content string")
        begin = time.time()
        out = rule_tables.required_items(chunks).collect()
        return out, time.time() - begin

    few, _ = run(5)
    assert [r.item_name for r in few] == [f"指标{i}（以某计）" for i in range(5)] and all(r.condition == "限腌制产品" for r in few)
    many, _ = run(1700)
    assert len(many) == 1700 and many[-1].item_name == "指标1699（以某计）" and all(r.condition == "限腌制产品" for r in many)
    plain = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i).alias("rows"))
    scan = rule_tables._scanned(F.col("rows"), F.lit(0).cast("bigint"), "bigint", lambda s, out, x: F.struct((s + x).alias("state"), F.concat(out, F.array(s + x)).alias("out")))
    got = plain.select(scan.alias("p")).first().p
    assert got.state == 20_000 * 20_001 // 2 and len(got.out) == 20_000 and got.out[:3] == [1, 3, 6]
