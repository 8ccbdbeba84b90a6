"""Toxicity by compression distance: a window is closer to the text whose zstandard dictionary packs it shorter.

Two dictionaries are trained, one on ordinary text, one on the words that toxic text leans to. Both coders begin with the ordinary dictionary, so
that shared language costs the same under both, and only the toxic one goes on with the toxic dictionary. Every window of a text is packed by both;
the bytes the toxic coder saves are its gain. The gains of a text's windows become a probability by a logistic calibration on
labelled documents that the dictionaries were not trained on.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millaudit.llm.common import Words, sequence_hashes

#: Labelled documents learned from at most, by label, those whose ids hash lowest; longer ones than CHARS are not sampled. FIT in ten train, the others calibrate.
ORDINARY_ROWS, TOXIC_ROWS, CHARS, FIT = 4_000, 6_000, 20_000, 7
#: Bytes of a window, of the two dictionaries and of the segments they are made of; samples used for one.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, SAMPLES = 64, 32_768, 8_192, 32, 20_000
#: Compression level and the shortest repeat it may use; toxic words are at least so many times as frequent in toxic text, with such a chi-square.
LEVEL, REPEAT, RATIO, ASSOCIATED = 6, 5, 4.0, 25.0
#: Documents with this score or more are predicted toxic; the share of documents, by crc32 of the id modulo FOLDS, that nothing is learned from.
THRESHOLD, FOLDS, HELD = 0.3, 4, 2
#: Stands before every window and ends both dictionaries, so that no window is too short to be packed.
FILLER = bytes(range(128, 224))


def normalised(text: str | None) -> bytes:
    """Lower-cased words between single spaces."""
    return f" {' '.join((text or '').lower().split())} ".encode("utf-8", "surrogatepass")


def windows(data: bytes) -> list[bytes]:
    """The whole text in windows of WINDOW bytes at most, cut before spaces where there are some."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        if end < len(data):
            space = data.rfind(b" ", at + 1, end)
            end = space if space > at else end
        out.append(data[at:end])
        at = end
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; too few to train on stand for themselves."""
    if len(samples) > SAMPLES:
        samples = [samples[i] for i in np.linspace(0, len(samples) - 1, SAMPLES).astype(int)]
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6, accel=1, level=LEVEL).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _coder(content: bytes) -> zstandard.ZstdCompressor:
    content += FILLER
    whole = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW + len(FILLER), dict_size=len(content), min_match=REPEAT, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    whole.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=whole, compression_params=parameters)


class Distance:
    """Both coders of a trained pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _coder(ordinary + bytes(len(toxic))), _coder(ordinary + toxic)

    def gains(self, text: str | None) -> np.ndarray:
        """The bytes that the toxic coder saves against the ordinary one, by window."""
        return np.array([len(self.ordinary.compress(FILLER + w)) - len(self.toxic.compress(FILLER + w)) for w in windows(normalised(text))], float)


def features(gains: np.ndarray) -> list[float]:
    """What a text's windows say together: their mean, their best ones, and how many gain."""
    if not gains.size:
        gains = np.zeros(1)
    best = np.sort(gains)[::-1][:3]
    some, much = gains >= 2, gains >= 4
    return [
        10 * gains.mean(), best[0], best.mean(), np.log1p(some.sum()), np.log1p(much.sum()), 10 * some.mean(), 10 * much.mean(), np.log(gains.size),
        np.log1p(np.maximum(gains - 1, 0).sum()), np.log1p(max(0.0, gains.sum())),
    ]


@dataclass
class Model:
    """Two dictionaries, and the calibration of what they say."""

    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack(((x - self.centre) / self.scale, np.ones(len(x)))) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def leaning_words(ordinary: list[bytes], toxic: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of toxic texts, and which of them are told by chi-square and ratio over the contexts they stand in.

    A context is a word with its two neighbours and counts once however often it occurs, so that copies of one text count as one.
    """
    sides, found = [Words(ordinary), Words(toxic)], []
    for words in sides:
        inside = words.row[2:] == words.row[:-2]
        contexts, first = np.unique(sequence_hashes(words.hashes, 3)[inside], return_index=True)
        found.append(np.unique(words.hashes[1:-1][inside][first], return_counts=True) if contexts.size else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    (other, plain), (own, count) = found
    n = np.array([max(1, plain.sum()), max(1, count.sum())], float)
    place = np.minimum(np.searchsorted(other, own), max(0, other.size - 1))
    against = np.where(other[place] == own, plain[place], 0) if other.size else np.zeros(own.size)
    both = count + against
    expected = both * n[1] / n.sum()
    spread = both * (n.sum() - both) / n.sum() * n[0] / n.sum() * n[1] / n.sum()
    telling = own[(count / n[1] >= RATIO * against / n[0]) & (count > expected) & ((count - expected) ** 2 >= ASSOCIATED * np.maximum(spread, 1e-12))]
    return sides[1], np.isin(sides[1].hashes, telling)


def _distinct(rows: list[tuple]) -> list[tuple]:
    """One of the texts with the same smallest hash of three words and the same label: most copies go."""
    words = Words([r[1] for r in rows])
    out = {}
    for i, row in enumerate(rows):
        own = sequence_hashes(words.hashes[words.first[i] : words.first[i] + words.count[i]], min(3, max(1, int(words.count[i]))))
        out.setdefault((int(own.min()) if own.size else None, row[2]), row)
    return list(out.values())


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a logistic regression by Newton steps with a small penalty."""
    if not len(y):
        return np.zeros(10), np.ones(10), np.concatenate((np.zeros(10), [-3.0]))
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - centre) / scale, np.ones(len(x))))
    w, penalty = np.zeros(z.shape[1]), np.array([1.0] * x.shape[1] + [0.1])

    def loss(w):
        return weight @ (np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * penalty @ w**2

    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * w)
        while loss(w - step) > loss(w) + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return centre, scale, w


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that nothing is learned from. A null id is none of them, and has no label to learn."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, ordinary_rows: int = ORDINARY_ROWS, toxic_rows: int = TOXIC_ROWS) -> Model:
    """A model from a bounded sample of labelled documents that are not held out.

    A document with several label rows is toxic if one of them says so; null labels and null ids are left out. Without toxic labels
    every score is small.
    """
    judged = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    able = documents.where(F.length("text") <= CHARS).select("doc_id").distinct().join(judged, "doc_id").where(~held_out())
    totals = {r.label: r["n"] for r in able.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = able.where("label = 0").orderBy(*order).limit(ordinary_rows).unionAll(able.where("label = 1").orderBy(*order).limit(toxic_rows))
    rows = documents.where(F.length("text") <= CHARS).select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])  # ids are limited above
    sample = sorted((zlib.crc32(f"sample {r.doc_id}".encode()), normalised(r.text), r.label, str(r.doc_id)) for r in rows.collect())
    fitted = _distinct([r for r in sample if r[0] % 10 < FIT])
    plain, toxic = ([r[1] for r in fitted if r[2] == label] for label in (0, 1))
    words, told = leaning_words(plain, toxic)
    runs = np.flatnonzero(told)
    pieces = [b" " + b" ".join(words.raw[words.starts[i] : words.ends[i]] for i in runs[at : at + 8].tolist()) + b" " for at in range(0, runs.size, 8)]
    both = dictionary([w for t in plain for w in windows(t)], ORDINARY_BYTES), dictionary(pieces, TOXIC_BYTES)
    distance = Distance(*both)
    tested = _distinct([r for r in sample if r[0] % 10 >= FIT])
    x = np.array([features(distance.gains(r[1].decode("utf-8", "surrogatepass"))) for r in tested]).reshape(len(tested), 10)
    y = np.array([r[2] for r in tested], float)
    shares = {label: totals.get(label, 0) / max(1, sum(r[2] == label for r in sample)) for label in (0, 1)}  # sampled labels weigh as all of theirs
    weight = np.array([shares[r[2]] for r in tested]) / (np.mean([shares[r[2]] for r in tested]) if tested else 1)
    return Model(*both, *_calibrated(x, y, weight))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with held_out, score (0 to 1) and predicted (1 from THRESHOLD).

    A null text counts as empty; empty texts get the score of a text without gains. Repeated rows get equal scores. Columns of the same names in the
    input are replaced. Texts are read whole, window by window.
    """
    handed = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size and eleven weights
    rows = documents.drop("held_out", "score", "predicted").withColumn("held_out", held_out())
    schema = StructType(list(rows.schema.fields)).add("score", "double").add("predicted", "integer")

    def run(batches):
        distance = Distance(handed.value.ordinary, handed.value.toxic)
        for batch in batches:
            x = np.array([features(distance.gains(t.as_py())) for t in batch.column("text")]).reshape(batch.num_rows, 10)
            p = handed.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return rows.mapInArrow(run, schema)
