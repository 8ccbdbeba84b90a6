"""Near duplicates: what tasks send on grows with the members of a group, not with its pairs."""

import numpy as np

from millaudit.llm import near_dup

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 12}", len(t or "")) for i, t in texts], DOCUMENTS)


def test_near_copies_that_hardly_link_leave_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    texts = []  # every shingle occurs elsewhere, and few pairs link
    for i in range(80):
        texts.append((i, " ".join(f"{'b' if flip else 'a'}{n}x{j}" for n, flip in enumerate(rng.random(40) < 0.1) for j in range(12))))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(476)} for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    numbers, write = {}, near_dup.written

    def counted(rows, name):
        out = write(rows, name)
        numbers[name] = out.count()
        return out

    monkeypatch.setattr(near_dup, "written", counted)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs(spark, texts)).collect()}
    assert got == root and len(set(root.values())) > 10
    assert numbers["rest"] > len(texts) >= numbers["across"]


def test_every_two_blocks_of_a_bucket_meet(spark):
    texts = [(i, " ".join(f"{'b' if n == i else 'a'}{n}" for n in range(60))) for i in range(40)] + [(i, " ".join(f"c{i}x{n}" for n in range(60))) for i in range(40, 50)]
    base = near_dup.sketches(docs(spark, texts))
    sets = base.where("set_id is not null")
    row, value, count = near_dup.shingle_sets([t.encode() for _, t in texts])
    shingles = spark.createDataFrame([(int(s), bytearray(v.tobytes())) for s, v in zip(near_dup.set_ids(row, value, count).view(np.int64), np.split(value, np.cumsum(count)[:-1]))], "set_id bigint, shingles binary")
    members = near_dup.bands(sets).join(sets.select("set_id", "n_shingles"), "set_id")
    members = members.selectExpr("key", "set_id", "set_id as set_id_root", "n_shingles", "n_shingles as total").join(near_dup.held_elsewhere(shingles), "set_id")
    members = members.join(sets.select("set_id", "registers"), "set_id").cache()
    several = members.groupBy("key").count().where("count > 1").select("key")
    members = members.join(several, "key")
    id_of = {r.set_id: r.doc_id for r in sets.select("set_id", "doc_id").collect()}
    found = []
    for tile, most in ((1024, 10**6), (5, 10**6), (1024, 400)):
        partners = near_dup.able_partners(members, near_dup.LINK, tile, most).cache()
        pairs = sorted(tuple(sorted((id_of[r.set_id], id_of[p]))) for r in partners.collect() for p in r.partners)
        assert len(pairs) == len(set(pairs)) and pairs  # in one bucket each
        found.append(pairs)
        root = {i: i for i, _ in texts}
        for a, b in near_dup.joining_links(partners, shingles, near_dup.LINK).collect():
            low, high = sorted((root[id_of[a]], root[id_of[b]]))
            root = {i: low if r == high else r for i, r in root.items()}
        assert all(root[i] == (0 if i < 40 else i) for i in root)
    assert found[0] == found[1] == found[2]
