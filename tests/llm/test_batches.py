"""What a Python task holds and sends at once: few documents, and each text once."""

import pyarrow as pa

import public_tokenizers
from millaudit.llm import packing, quality

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pieces_leave_in_small_batches():
    batch = pa.record_batch({"doc_id": pa.array(range(2300)), "text": pa.array([f"text {i}" * 50 for i in range(2300)])})
    out = list(packing._pieces(public_tokenizers.path("word_bpe_49k.json"), packing.SIZE, True)(iter([batch])))
    assert max(b.num_rows for b in out) <= 1000
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == list(range(2300))


def test_a_carried_text_goes_to_python_once(spark):
    d = spark.createDataFrame([(1, "one Two ***", "en", "s1", 11), (2, None, "en", "s2", 0), (3, "four five\nsix", "en", "s3", 13)], DOCUMENTS)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality.labelled_rows(d, labels, 10)
    inputs, written = [], quality.written
    quality.written = lambda found, name: inputs.append(found) or written(found, name)
    try:
        whole, ids = (quality.feature_rows(rows, c).orderBy("doc_id").collect() for c in (d.columns, ["doc_id"]))
    finally:
        quality.written = written
    assert [(r.doc_id, r.quality, r.toxic, r.held, r.content, r.metadata) for r in whole] == [(r.doc_id, r.quality, r.toxic, r.held, r.content, r.metadata) for r in ids]
    assert [r.document.text for r in whole] == ["one Two ***", None, "four five\nsix"]
    given = [str(i._jdf.queryExecution().analyzed().children().head().output().toString()) for i in inputs]  # what goes to Python
    assert "document#" in given[0] and " text#" not in given[0] and " text#" in given[1]
