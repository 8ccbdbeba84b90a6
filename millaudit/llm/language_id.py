"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability per language. A word's probability is the sum over all its segmentations
into pieces (forward algorithm); a text's is the product over its words. Piece probabilities are fitted by expectation
maximisation over the same sums on a bounded sample of each language's documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Documents a language is learned from at most, and its most frequent words taken from them.
TRAIN_DOCUMENTS, TRAIN_WORDS = 400, 20_000
#: Rounds of fitting; probability left to pieces never seen; longest piece; longest stretch of a word scored in one go.
ROUNDS, UNSEEN, LONGEST, STRETCH = 4, 1e-7, 8, 24
#: Words whose scores a Python worker remembers.
REMEMBERED = 600_000
#: Words scored together.
TOGETHER = 100_000
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that spell text, a word's first piece opening with the start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def _letter_runs(text: str) -> list[str]:
    """Runs of letters, as the training sample takes them: numerals such as ½ and ② count as word characters to the pattern but are none."""
    found = _LETTERS.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [run for w in found for run in "".join(c if c.isalpha() else " " for c in w).split()]


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case, each behind the start mark; a longer run in stretches that are all scored."""
    out = []
    for w in _letter_runs((text or "").lower()):
        if len(w) <= STRETCH:
            out.append(_START + w)
        else:
            out += [(_START if i == 0 else "") + w[i : i + STRETCH] for i in range(0, len(w), STRETCH)]
    return out


class Lattice:
    """All pieces inside some words: piece[w, i, l] begins at i and is l + 1 long, -1 where there is none."""

    def __init__(self, words: list[str], number: dict[str, int], unknown: int):
        self.lengths = np.array([len(w) for w in words])
        longest = int(self.lengths.max(initial=1))
        piece = np.full((len(words), longest, LONGEST), -1, np.int32)
        get = number.get
        for row, w in enumerate(words):
            n = len(w)
            for i in range(n):
                one = get(w[i])
                piece[row, i, 0] = unknown if one is None else one  # every letter can stand alone
                for size in range(2, min(LONGEST, n - i) + 1):
                    found = get(w[i : i + size])
                    if found is not None:
                        piece[row, i, size - 1] = found
        self.piece = piece

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: pieces x languages, a zero row last. alpha[w, i, language]: sum over segmentations of the first i letters."""
        words, longest, sizes = self.piece.shape
        alpha = np.zeros((words, longest + 1, p.shape[1]))
        alpha[:, 0] = 1
        for end in range(1, longest + 1):
            for size in range(1, min(sizes, end) + 1):
                alpha[:, end] += alpha[:, end - size] * p[self.piece[:, end - size, size - 1]]
        return alpha

    def backward(self, p: np.ndarray) -> np.ndarray:
        words, longest, sizes = self.piece.shape
        beta = np.zeros((words, longest + 1, p.shape[1]))
        beta[np.arange(words), self.lengths] = 1
        for begin in range(longest - 1, -1, -1):
            for size in range(1, min(sizes, longest - begin) + 1):
                beta[:, begin] += beta[:, begin + size] * p[self.piece[:, begin, size - 1]]
        return beta

    def totals(self, p: np.ndarray) -> np.ndarray:
        alpha = self.forward(p)
        return alpha[np.arange(len(self.lengths)), self.lengths]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, given the words' weights per language."""
        alpha, beta = self.forward(p), self.backward(p)
        share = weight / np.maximum(alpha[np.arange(len(self.lengths)), self.lengths], 1e-300)
        out = np.zeros_like(p)
        words, longest, sizes = self.piece.shape
        for begin in range(longest):
            for size in range(1, min(sizes, longest - begin) + 1):
                ids = self.piece[:, begin, size - 1]
                held = ids >= 0
                np.add.at(out, ids[held], (share * alpha[:, begin] * beta[:, begin + size] * p[ids])[held])
        return out


class Model:
    """Languages, their prior, the vocabulary's numbers and the pieces' probabilities per language."""

    def __init__(self, languages: list[str], prior: np.ndarray, pieces: list[str], counts: dict[str, np.ndarray]):
        self.languages, self.prior = languages, prior
        self.number = {p: i for i, p in enumerate(pieces) if len(p) <= LONGEST}
        self.unknown = len(pieces)
        self.p = np.zeros((len(pieces) + 2, len(languages)))
        self.p[:-1] = 1.0 / (len(pieces) + 1)
        words = sorted(counts)
        weight = np.array([counts[w] for w in words]).reshape(len(words), len(languages))
        lattices = [(Lattice(words[i : i + 4000], self.number, self.unknown), weight[i : i + 4000]) for i in range(0, len(words), 4000)]
        for _ in range(ROUNDS if words else 0):
            expected = sum(x.expected(self.p, w) for x, w in lattices)[:-1]
            share = expected / np.maximum(expected.sum(axis=0), 1e-300)
            self.p[:-1] = (share + UNSEEN) / (share + UNSEEN).sum(axis=0)

    def scorer(self) -> Scorer:
        """One per Python worker, so that tasks go on with the words that earlier ones scored."""
        if not hasattr(self, "_scorer"):
            self._scorer = Scorer(self)
        return self._scorer

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 5000):
            own = order[at : at + 5000]
            out[own] = np.log(np.maximum(Lattice([words[i] for i in own], self.number, self.unknown).totals(self.p), 1e-300))
        return out


class Scorer:
    """Scores of texts; words are remembered up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((REMEMBERED, len(self.model.languages)), np.float32)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Prediction and score of each text; new words of many texts are scored together."""
        out, held, size = [], [], 0
        for text in texts:
            words = words_of(text)
            held.append(words)
            size += len(words)
            if size > TOGETHER:
                out += self._predict(held)
                held, size = [], 0
        return out + self._predict(held)

    def _predict(self, held: list[list[str]]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(held)
        total = np.tile(np.log(self.model.prior), (len(held), 1))
        rows: list[int] = []
        parts: list[str] = []

        def add():
            if parts:
                np.add.at(total, np.repeat(rows, counts), self._scores(parts).astype(np.float64))

        counts: list[int] = []
        for i, words in enumerate(held):
            for at in range(0, len(words), TOGETHER):  # a very long text in portions
                portion = words[at : at + TOGETHER]
                rows.append(i)
                counts.append(len(portion))
                parts += portion
                if len(parts) > TOGETHER:
                    add()
                    rows, parts, counts = [], [], []
        add()
        best = total.argmax(axis=1)  # ties: the first language in order
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [(self.model.languages[b], float(p)) if words else (UNKNOWN, 0.0) for words, b, p in zip(held, best.tolist(), share.tolist())]

    def _scores(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if len(self.row) + len(new) > REMEMBERED:
            self._forget()
            new = list(dict.fromkeys(words))
        if new:
            first = len(self.row)
            self.scores[first : first + len(new)] = self.model.word_scores(new)
            self.row.update(zip(new, range(first, first + len(new))))
        return self.scores[list(map(self.row.__getitem__, words))]


def held_out():
    """crc32 of the doc_id's text leaves 2 modulo 4; a null id is not held out, and not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, vocabulary_path: str, train_documents: int = TRAIN_DOCUMENTS, train_words: int = TRAIN_WORDS) -> Model:
    """A model of all languages of the learnable documents.

    The prior counts every learnable document. Each language's pieces are learned from ``train_documents`` of its documents at most, those whose
    id hashes lowest, and from their ``train_words`` most frequent words.
    """
    learnable = documents.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    prior = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(prior)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = learnable.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= train_documents)
    counted = (
        sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n"))
    )
    frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = counted.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= train_words).select("lang", "word", "n").collect()
    counts: dict[str, np.ndarray] = {}
    place = {x: i for i, x in enumerate(languages)}
    for lang, word, n in rows:
        for w in words_of(word):
            counts.setdefault(w, np.zeros(len(languages)))[place[lang]] += n
    total = np.array([prior[x] for x in languages], float)
    return Model(languages, total / max(total.sum(), 1), vocabulary(vocabulary_path), counts)


def predicted(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document row from its whole text alone.

    The score is the prediction's probability among the learned languages. A text that is null or has no letter gets `und` with score
    0, and so do all if no language was learned. Repeated rows come back as often as they came; extra columns are left out.
    """
    handed = documents.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages numbers

    def run(batches):
        scorer = handed.value.scorer()
        for batch in batches:
            found = scorer.texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
