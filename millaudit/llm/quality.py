"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

Both views are linear over hashed features: a logistic regression fitted on a bounded labelled sample, and naive Bayes odds from counts over
that sample and every other document the other view is sure about. In each round either view scores all documents, and those it is
surest about are counted for the other view by Spark. Views, and at the end their sum, are calibrated on labelled documents
that neither learned from, and every document is scored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from millaudit.llm.common import written

#: Labelled documents learned from at most; one in FOLD of them, by id, calibrates.
LABELLED_ROWS, FOLD = 10_000, 4
#: Letters of the word beginnings that are features besides whole words.
PREFIXES = (5, 7)
#: How surely a feature must go with a target to be used, as chi-square of its documents.
ASSOCIATED = 25.0
ROUNDS, EXCHANGED, SURE = 3, 0.1, 0.95
STEPS, RATE, DECAY = 200, 0.1, 1e-4
#: Log-odds are clipped at LIMIT and ordered in BINS steps of one. Documents looked at and features counted together.
LIMIT, BINS, CHUNK, COUNTED = 30, 64, 500, 2_000_000
TARGETS = ("quality", "toxic")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_LETTER, _UPPER = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def _hash(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass"))


class Features:
    """Both views of a document as hashed features; 32 bits, so that a telling word hardly ever shares its hash."""

    def content(self, text: str | None) -> np.ndarray:
        """Words, how longer words begin, symbol runs, and how much the text repeats itself."""
        tokens = _TOKEN.findall((text or "").lower())
        distinct = set(tokens)
        n = len(tokens)
        doubled = sum(map(str.__eq__, tokens, tokens[1:])) + sum(map(str.__eq__, tokens, tokens[2:]))
        shape = [_hash(f"\x00doubled {min(9, 20 * doubled // max(n, 1))}"), _hash(f"\x00distinct {10 * len(distinct) // max(n, 1)} {n.bit_length() // 2}")]
        begins = {t[:n] for n in PREFIXES for t in distinct if len(t) > n}
        return np.unique(np.array([_hash(t) for t in distinct] + [_hash("\x02" + t) for t in begins] + shape, np.int64))

    def metadata(self, text: str | None, lang, source, n_chars) -> np.ndarray:
        """Source, language, length and layout of the page."""
        text = text or ""
        size = max(len(text), 1)
        lines = text.count("\n") + 1
        letters = len(text) - len(_LETTER.sub("", text))
        upper = len(text) - len(_UPPER.sub("", text))
        spaces = text.count(" ") + lines - 1
        names = [
            f"source {source}", f"lang {lang}", f"chars {None if n_chars is None else int(n_chars).bit_length()}", f"lines {lines.bit_length()}",
            f"line {(size // lines).bit_length()}", f"letters {20 * letters // size}", f"upper {20 * upper // size}", f"spaces {20 * spaces // size}",
            f"symbols {20 * max(0, size - letters - spaces) // size}",
        ]
        return np.unique(np.array([_hash("\x01" + x) for x in names], np.int64))


@dataclass
class Sample:
    """Feature lists of documents, flat."""

    ids: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Sample:
        sizes = np.array([len(r) for r in rows], np.int64)
        return cls(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(sizes))))

    def __len__(self) -> int:
        return len(self.begins) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.begins))

    def take(self, rows: np.ndarray) -> Sample:
        return Sample.of([self.ids[self.begins[i] : self.begins[i + 1]] for i in rows.tolist()])


@dataclass
class View:
    """A logistic regression over chosen features, sorted."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def odds(self, x: Sample) -> np.ndarray:
        if not self.features.size:
            return np.full(len(x), self.bias)
        place = np.minimum(np.searchsorted(self.features, x.ids), self.features.size - 1)
        known = np.flatnonzero(self.features[place] == x.ids)
        return np.bincount(x.rows()[known], self.weights[place[known]], len(x)) + self.bias


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def associated(x: Sample, y: np.ndarray) -> np.ndarray:
    """The features whose documents differ from the others in the target, by chi-square."""
    features, number = np.unique(x.ids, return_inverse=True)
    n, good = len(y), y.sum()
    with_feature = np.bincount(number, minlength=features.size)
    both = np.bincount(number, y[x.rows()], features.size)
    expected = with_feature * good / n
    spread = with_feature * (n - with_feature) / n * good * (n - good) / n**2
    return features[(both - expected) ** 2 >= ASSOCIATED * np.maximum(spread, 1e-12)]


def fitted(x: Sample, y: np.ndarray) -> View:
    """A logistic regression over the associated features, full batch."""
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
    if not len(y) or not 0 < y.mean() < 1:
        return View(np.zeros(0, np.int64), np.zeros(0), bias)
    features = associated(x, y)
    if not features.size:
        return View(features, np.zeros(0), bias)
    place = np.minimum(np.searchsorted(features, x.ids), features.size - 1)
    known = features[place] == x.ids
    row, column = x.rows()[known], place[known]
    k, n = features.size, len(y)
    w, m, v, mb, vb = np.zeros(k), np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, STEPS + 1):
        miss = (_p(np.bincount(row, w[column], n) + bias) - y) / n
        g = np.bincount(column, miss[row], k) + DECAY * w
        gb = float(miss.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.999**t
        w -= RATE * (m / up) / (np.sqrt(v / down) + 1e-8)
        bias -= RATE * (mb / up) / ((vb / down) ** 0.5 + 1e-8)
    return View(features, w, bias)


def _calibration(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of the views' log-odds and a constant, by a few Newton steps with a small penalty."""
    z = np.column_stack((np.clip(z, -30, 30), np.ones(len(z))))
    c = np.array([0.5] * (z.shape[1] - 1) + [0.0])
    if not len(y) or not 0 < y.mean() < 1:
        c[:-1] = 0
        c[-1] = 0.0 if not len(y) else float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        return c
    prior = c.copy()

    def loss(c):
        return np.logaddexp(0, z @ c).sum() - y @ (z @ c) + 0.5 * ((c - prior) ** 2).sum()

    for _ in range(25):
        p = _p(z @ c)
        g = z.T @ (p - y) + 1.0 * (c - prior)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1.0 * np.eye(len(c))
        step = np.linalg.solve(h, g)
        for _ in range(30):  # a whole step may go too far where all odds are large
            if loss(c - step) <= loss(c):
                c = c - step
                break
            step = step / 2
    return c


@dataclass
class Classifier:
    """Per target the two views and their calibration."""

    views: dict[str, tuple[View, View]]
    calibration: dict[str, np.ndarray]

    def scores(self, content: Sample, metadata: Sample) -> dict[str, np.ndarray]:
        out = {}
        for target, (a, b) in self.views.items():
            z = np.column_stack((np.clip(a.odds(content), -30, 30), np.clip(b.odds(metadata), -30, 30), np.ones(len(content))))
            out[target] = _p(z @ self.calibration[target])
        return out


def counted(features: np.ndarray, n: np.ndarray, good: np.ndarray, rows: float, rows_good: float) -> View:
    """Naive Bayes odds from the documents and good documents of every feature."""
    p, q = (good + 1) / (rows_good + 2), (n - good + 1) / (rows - rows_good + 2)
    order = np.argsort(features)
    weights = np.log(p / (1 - p)) - np.log(q / (1 - q))
    return View(features[order], weights[order], float(np.log((rows_good + 1) / (rows - rows_good + 1)) + np.log((1 - p) / (1 - q)).sum()))


def stacked(base: View, taught: View | None, held: Sample, y: np.ndarray) -> View:
    """One view of calibrated log-odds from the fitted and the counted one."""
    parts = [base]
    if taught is not None:
        scale = max(1.0, float(taught.odds(held).std()) if len(held) else 1.0)  # words of a text go together, so their odds add up to too much
        parts.append(View(taught.features, taught.weights / scale, taught.bias / scale))
    c = _calibration(np.column_stack([v.odds(held) for v in parts]), y)
    features, place = np.unique(np.concatenate([v.features for v in parts]), return_inverse=True)
    weights = np.bincount(place, np.concatenate([k * v.weights for k, v in zip(c, parts)]), features.size)
    return View(features, weights, float(sum(k * v.bias for k, v in zip(c, parts)) + c[-1]))


def _bins(z: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(z, -LIMIT, LIMIT) + LIMIT) * BINS).astype(np.int64)


#: The bins from which a view is sure.
SURE_LOW, SURE_HIGH = int(_bins(np.log([(1 - SURE) / SURE]))[0]) - 1, int(_bins(np.log([SURE / (1 - SURE)]))[0]) + 1


def _chunks(batches):
    """(quality, toxic, held, and both views) of a few documents at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(at, CHUNK)
            known = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in TARGETS]
            views = [Sample.of([np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(c).to_pylist()]) for c in ("content", "metadata")]
            yield known, batch.column("held").to_numpy(zero_copy_only=False).astype(bool), views


def sure_bins(rows: DataFrame, models: dict[str, tuple[View, View]]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """By target and teacher: the bins below and above which documents teach, and how many documents that is.

    These are the EXCHANGED of all unlabelled documents with the lowest and highest odds, with ties, as far as the teacher is sure.
    """
    handed = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        found = np.zeros((len(TARGETS), 2, 2 * LIMIT * BINS + 1), np.int64)
        for known, _, views in _chunks(batches):
            free = np.isnan(known[0])
            for t, target in enumerate(TARGETS):
                for v in (0, 1):
                    found[t, v] += np.bincount(_bins(handed.value[target][v].odds(views[v]))[free], minlength=found.shape[2])
        t, v, b = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(v), pa.array(b), pa.array(found[t, v, b])], names=["t", "v", "b", "n"])

    table = rows.mapInArrow(run, "t bigint, v bigint, b bigint, n bigint").groupBy("t", "v", "b").agg(F.sum("n").alias("n")).toArrow()
    number = np.zeros((len(TARGETS), 2, 2 * LIMIT * BINS + 1), np.int64)
    number[tuple(table.column(c).to_numpy() for c in ("t", "v", "b"))] = table.column("n").to_numpy()
    out = {}
    for t in range(len(TARGETS)):
        for v in (0, 1):
            up = np.cumsum(number[t, v])
            most = max(1, int(EXCHANGED * up[-1]))
            low = min(SURE_LOW, int(np.searchsorted(up, most)))
            high = max(SURE_HIGH, int(np.searchsorted(up, up[-1] - most, side="right")))
            out[t, v] = low, high, int(up[low]), int(up[-1] - up[high - 1])
    return out


def feature_counts(rows: DataFrame, models: dict[str, tuple[View, View]], bins: dict) -> DataFrame:
    """(view, feature, n0, good0, n1, good1): documents and good ones by target, over labelled documents and those the other view is sure about."""
    handed = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        kept, size = [[], []], [0, 0]

        def flush(v):
            ids, which = (np.concatenate(x) for x in zip(*kept[v]))
            kept[v], size[v] = [], 0
            features, place = np.unique(ids, return_inverse=True)
            columns = []
            for t in range(len(TARGETS)):
                label = which // 3**t % 3  # 0 and 1 are labels, 2 is none
                columns += [np.bincount(place, label < 2, features.size).astype(np.int64), np.bincount(place, label == 1, features.size).astype(np.int64)]
            arrays = [pa.array(np.full(features.size, v)), pa.array(features.astype(np.int64)), *map(pa.array, columns)]
            yield from pa.Table.from_arrays(arrays, names=["view", "feature", "n0", "good0", "n1", "good1"]).to_batches(max_chunksize=50_000)

        for known, held, views in _chunks(batches):
            for v in (0, 1):
                which = np.zeros(len(held), np.int64)
                for t, target in enumerate(TARGETS):
                    b = _bins(handed.value[target][1 - v].odds(views[1 - v]))
                    low, high = bins[t, 1 - v][:2]
                    taught = np.where(b <= low, 0, np.where(b >= high, 1, 2))
                    which += 3**t * np.where(np.isnan(known[t]), taught, np.where(held, 2, known[t] > 0))
                own = views[v].take(np.flatnonzero(which < 8))
                if own.ids.size:
                    kept[v].append((own.ids.astype(np.uint32), which[which < 8].astype(np.int8)[own.rows()]))
                    size[v] += own.ids.size
                if size[v] >= COUNTED:
                    yield from flush(v)
        for v in (0, 1):
            if kept[v]:
                yield from flush(v)

    names = ["n0", "good0", "n1", "good1"]
    found = rows.mapInArrow(run, "view bigint, feature bigint, n0 bigint, good0 bigint, n1 bigint, good1 bigint")
    return found.groupBy("view", "feature").agg(*[F.sum(c).alias(c) for c in names])


def co_trained(rows: DataFrame, labelled: tuple[Sample, Sample], ys: dict[str, np.ndarray], held: np.ndarray) -> dict[str, tuple[View, View]]:
    """By target the two views after they have taught each other on every row."""
    learn, test = ([x.take(np.flatnonzero(part)) for x in labelled] for part in (~held, held))
    base = {t: [fitted(x, y[~held]) for x in learn] for t, y in ys.items()}
    models = {t: tuple(stacked(b, None, x, ys[t][held]) for b, x in zip(base[t], test)) for t in TARGETS}
    for _ in range(ROUNDS):
        bins = sure_bins(rows, models)
        if not any(low + high for *_, low, high in bins.values()):
            break
        totals, told = {}, F.lit(False)
        for t, target in enumerate(TARGETS):
            y = ys[target][~held]
            for v in (0, 1):
                _, _, low, high = bins[t, 1 - v]
                n, good = totals[t, v] = float(len(y) + low + high), float(y.sum() + high)
                if 0 < good < n:
                    miss, with_feature = F.col(f"good{t}") - F.col(f"n{t}") * F.lit(good / n), F.col(f"n{t}")
                    spread = with_feature * (F.lit(n) - with_feature) * F.lit(good / n * (n - good) / n / n)
                    told = told | (F.col("view") == v) & (miss * miss >= F.lit(ASSOCIATED) * F.greatest(spread, F.lit(1e-12)))
        table = feature_counts(rows, models, bins).where(told).toArrow()
        column = {c: table.column(c).to_numpy() for c in table.column_names}
        taught = {t: [] for t in TARGETS}
        for t, target in enumerate(TARGETS):
            for v in (0, 1):
                (n, good), x, g = totals[t, v], column[f"n{t}"], column[f"good{t}"]
                spread = x * (n - x) * (good / max(n, 1) * (n - good) / max(n, 1) ** 2)
                own = (column["view"] == v) & ((g - x * good / max(n, 1)) ** 2 >= ASSOCIATED * np.maximum(spread, 1e-12)) & (0 < good < n)
                taught[target].append(counted(column["feature"][own], x[own], g[own], n, good) if own.any() else None)
        models = {t: tuple(stacked(b, c, x, ys[t][held]) for b, c, x in zip(base[t], taught[t], test)) for t in TARGETS}
    return models


def _views(batch: pa.RecordBatch, features: Features) -> tuple[list, list]:
    inside = batch.column("document") if "document" in batch.schema.names else None
    columns = [(batch.column(c) if c in batch.schema.names else pc.struct_field(inside, c)).to_pylist() for c in ("text", "lang", "source", "n_chars")]
    return [features.content(t) for t in columns[0]], [features.metadata(*row) for row in zip(*columns)]


def feature_rows(rows: DataFrame, carried: list[str]) -> DataFrame:
    """(doc_id, quality, toxic, held, document, content, metadata) of documents, written once for all rounds and for the scores; document holds the carried columns.

    A carried text is read from there, so that it goes to Python once.
    """

    kept = ["doc_id", *TARGETS, "held", "document"]

    def run(batches):
        features = Features()
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                views = [pa.array([x.astype(np.uint32).tobytes() for x in view], pa.binary()) for view in _views(batch, features)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *views], names=[*kept, "content", "metadata"])

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == FOLD - 1
    document = F.struct(*[F.col("document")[c].alias(c) for c in carried]).alias("document")
    given = rows.schema["document"].dataType
    kinds = [(c, kind) for c, kind in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")) if c not in carried or given[c].dataType.simpleString() != kind]
    read = [F.col("document")[c].cast(kind).alias(c) for c, kind in kinds]
    picked = rows.select("doc_id", *read, *[F.col(t).cast("double") for t in TARGETS], F.coalesce(held, F.lit(False)).alias("held"), document)
    views = StructType().add("content", "binary").add("metadata", "binary")
    schema = StructType([picked.schema[c] for c in kept] + list(views.fields))
    return written(picked.mapInArrow(run, schema), "quality-features")


def labelled_rows(documents: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, quality, toxic, document): every document row as one value, with its labels if it is among the ``most`` whose ids hash lowest.

    A document with several label rows counts as bad if one of them says so. Null labels are left out.
    """
    judged = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    known = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", *[F.col(t).cast("int") for t in TARGETS])
    return documents.select("doc_id", F.struct(*documents.columns).alias("document")).join(F.broadcast(known), "doc_id", "left")  # known is limited above


def fit(documents: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> Classifier:
    """A classifier from at most ``most`` labelled documents and all others without their labels."""
    return trained(feature_rows(labelled_rows(documents, labels, most), ["doc_id"]))


def trained(features: DataFrame) -> Classifier:
    """A classifier from feature rows. Rows without a doc_id teach nothing."""
    rows = features.where("doc_id is not null").drop("document")
    labelled = sorted(rows.where("quality is not null").toArrow().to_pylist(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"]), r["content"]))
    both = tuple(Sample.of([np.frombuffer(r[c], np.uint32).astype(np.int64) for r in labelled]) for c in ("content", "metadata"))
    if not labelled:  # nothing was learned: every document passes
        none = View(np.zeros(0, np.int64), np.zeros(0), 0.0)
        return Classifier({t: (none, none) for t in TARGETS}, {"quality": np.array([0, 0, 30.0]), "toxic": np.array([0, 0, -30.0])})
    held = np.array([r["held"] for r in labelled])
    ys = {t: np.array([r[t] > 0 for r in labelled], float) for t in TARGETS}
    views = co_trained(rows, both, ys, held)
    test = [x.take(np.flatnonzero(held)) for x in both]
    return Classifier(views, {t: _calibration(np.column_stack([m.odds(x) for m, x in zip(views[t], test)]), ys[t][held]) for t in TARGETS})


def scored(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """The documents with their columns and p_quality, p_toxic and kept (p_quality >= 0.5 and p_toxic < 0.5).

    Null texts, languages, sources and lengths are values like others. Without any label every document is kept. Columns of the
    same names in the input are replaced.
    """
    handed = documents.sparkSession.sparkContext.broadcast(classifier)  # weights of the associated features of a bounded sample
    rows = documents.drop("p_quality", "p_toxic", "kept")
    schema = StructType(list(rows.schema.fields)).add("p_quality", "double").add("p_toxic", "double").add("kept", "boolean")

    def run(batches):
        features = Features()
        for batch in batches:
            content, metadata = _views(batch, features)
            p = handed.value.scores(Sample.of(content), Sample.of(metadata))
            kept = (p["quality"] >= 0.5) & (p["toxic"] < 0.5)
            columns = [*batch.columns, pa.array(p["quality"]), pa.array(p["toxic"]), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "p_quality", "p_toxic", "kept"])

    return rows.mapInArrow(run, schema)


def judged(documents: DataFrame, labels: DataFrame, carried: list[str] | None = None, most: int = LABELLED_ROWS) -> DataFrame:
    """The carried columns of every document (all by default) with p_quality, p_toxic and kept, as ``scored`` with a classifier fitted on them gives.

    Every text is split once: the classifier is trained from the written features, and the same features are scored.
    """
    carried = [c for c in carried or documents.columns if c not in ("p_quality", "p_toxic", "kept")]
    rows = feature_rows(labelled_rows(documents, labels, most), carried)
    handed = documents.sparkSession.sparkContext.broadcast(trained(rows))
    picked = rows.select("document", "content", "metadata")
    schema = StructType([picked.schema["document"]]).add("p_quality", "double").add("p_toxic", "double").add("kept", "boolean")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                views = [Sample.of([np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column(c).to_pylist()]) for c in ("content", "metadata")]
                p = handed.value.scores(*views)
                kept = (p["quality"] >= 0.5) & (p["toxic"] < 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("document"), pa.array(p["quality"]), pa.array(p["toxic"]), pa.array(kept)], names=schema.names)

    return picked.mapInArrow(run, schema).select("document.*", "p_quality", "p_toxic", "kept")


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier keeps, with the columns they came with."""
    named = documents.toDF(*[f"_{i}_{c}" if c in ("p_quality", "p_toxic", "kept") else c for i, c in enumerate(documents.columns)])
    return judged(named, labels).where("kept").select(*named.columns).toDF(*documents.columns)
