"""Language identification by unigram pieces, with all segmentations of a word summed.

Each language has a probability for each piece of a fixed public vocabulary.  A word's probability is the sum
over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words, which
are its runs of letters in lower case.  The probabilities come from labelled texts by expectation
maximisation: words are counted by language, expected piece counts come from forward and backward sums.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import in_slices
from .common import kept, released, stored

#: Runs of letters; longer ones are cut each so many letters, none are dropped.
LONGEST = 32
WORDS = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
#: About so many labelled texts of each language are learnt from at most, chosen by the hash of the text.
PER_LANGUAGE = 600
ROUNDS = 2
#: Added to each expected count; probability of a letter that the vocabulary lacks.
ADDED, UNKNOWN = 0.1, 1e-8
#: Words whose values a worker keeps.
CACHE = 200_000
UNDETERMINED = "und"


@dataclass
class Model:
    """Pieces in the vocabulary's order, languages in order, probabilities by piece and language."""

    pieces: list[str]
    languages: list[str]
    probability: np.ndarray


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model; U+2581 stands before the first letter of a word."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]


class Lattice:
    """The pieces that end at each place of a word, for many words at once."""

    def __init__(self, pieces: list[str]):
        import ahocorasick

        self.automaton, self.none, self.unknown = ahocorasick.Automaton(), len(pieces), len(pieces) + 1
        for i, piece in enumerate(pieces):
            if len(piece) <= LONGEST + 1:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.width = max(n for n, _ in self.automaton.values())

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths with the mark, and piece numbers by word, end and length; ``none`` where there is no piece."""
        size = np.array([len(w) + 1 for w in words])
        out = np.full((len(words), int(size.max()) + 1, self.width + 1), self.none, np.int32)
        rows, ends, lengths, numbers = [], [], [], []
        for row, word in enumerate(words):
            for end, (n, i) in self.automaton.iter("▁" + word):
                rows.append(row)
                ends.append(end + 1)
                lengths.append(n)
                numbers.append(i)
        out[rows, ends, lengths] = numbers
        alone = out[:, 1:, 1]
        alone[alone == self.none] = self.unknown
        return size, out

    def forward(self, ids: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of each beginning of each word, by word, end and language."""
        n, ends, width = ids.shape
        alpha = np.zeros((n, ends, p.shape[1]))
        alpha[:, 0] = 1
        for end in range(1, ends):
            k = np.arange(1, min(end, width - 1) + 1)
            alpha[:, end] = np.einsum("nkl,nkl->nl", alpha[:, end - k], p[ids[:, end, k]])
        return alpha


def _with_rest(probability: np.ndarray) -> np.ndarray:
    """Rows for no piece and for an unknown letter go to the end."""
    langs = probability.shape[1]
    return np.concatenate([probability, np.zeros((1, langs)), np.full((1, langs), UNKNOWN)])


def learn(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang") -> Model:
    """Fit a model to rows with a text and a language; others are left out.

    It learns from about ``PER_LANGUAGE`` texts of each language, chosen by their hash.  What comes to the
    driver is bounded by that, the vocabulary and the languages.  No labelled rows give a model without
    languages, which finds every text undetermined.
    """
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model(pieces, [], np.zeros((len(pieces), 0)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, PER_LANGUAGE / n))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{1,%d})" % LONGEST), F.lit(1)))
    counted = stored(chosen.select("lang", words.alias("word")).groupBy("lang", "word").count(), "words")

    probability = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(ROUNDS):
        expected = np.zeros_like(probability)
        for r in counted.mapInArrow(_expect(pieces, languages, probability), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toLocalIterator():
            expected[r.piece, r.lang] = r.n
        probability = (expected + ADDED) / (expected.sum(0) + ADDED * len(pieces))
    return Model(pieces, languages, probability)


def _expect(pieces: list[str], languages: list[str], probability: np.ndarray):
    """Expected counts of pieces over the segmentations of counted words."""

    def run(batches):
        lattice, p = Lattice(pieces), _with_rest(probability)
        at = {x: i for i, x in enumerate(languages)}
        total = np.zeros((len(p), len(languages)))
        for batch in batches:
            langs, words, counts = (batch.column(i).to_pylist() for i in range(3))
            for a in range(0, len(words), 2000):
                _, ids = lattice.ids(words[a : a + 2000])
                _count(lattice, ids, np.array([len(w) + 1 for w in words[a : a + 2000]]), np.array([at[x] for x in langs[a : a + 2000]]), np.array(counts[a : a + 2000], float), p, total)
        piece, lang = np.nonzero(total[: len(pieces)])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, lang])], names=["lang", "piece", "n"])

    return run


def _count(lattice: Lattice, ids: np.ndarray, size: np.ndarray, lang: np.ndarray, count: np.ndarray, p: np.ndarray, total: np.ndarray) -> None:
    n, ends, width = ids.shape
    own = p[ids, lang[:, None, None]]  # of each word's own language
    alpha, beta = np.zeros((n, ends)), np.zeros((n, ends))
    alpha[:, 0], beta[np.arange(n), size] = 1, 1
    for end in range(1, ends):
        k = np.arange(1, min(end, width - 1) + 1)
        alpha[:, end] = (alpha[:, end - k] * own[:, end, k]).sum(1)
    for end in range(ends - 1, 0, -1):
        k = np.arange(1, min(end, width - 1) + 1)
        beta[:, end - k] += own[:, end, k] * beta[:, end, None]
    scale = count / alpha[np.arange(n), size]
    for end in range(1, ends):
        k = np.arange(1, min(end, width - 1) + 1)
        found = alpha[:, end - k] * own[:, end, k] * (beta[:, end] * scale)[:, None]
        np.add.at(total, (ids[:, end, k], np.broadcast_to(lang[:, None], found.shape)), found)


class Scorer:
    """Log probabilities of words by language; keeps those it has seen."""

    def __init__(self, model: Model):
        self.model, self.lattice, self.p = model, Lattice(model.pieces), _with_rest(model.probability)
        self.at: dict[str, int] = {}
        self.values = np.zeros((0, len(model.languages)))

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.at) > CACHE:
            self.at, self.values = {}, self.values[:0]
        cut = [WORDS.findall(t.lower()) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in self.at})
        fresh = [self.values]
        for a in range(0, len(new), 2000):
            size, ids = self.lattice.ids(new[a : a + 2000])
            fresh.append(np.log(self.lattice.forward(ids, self.p)[np.arange(len(size)), size]))
        start = len(self.at)
        self.at.update((w, start + i) for i, w in enumerate(new))
        self.values = np.concatenate(fresh)
        langs, scores = [], []
        for text, words in zip(texts, cut):
            if not self.model.languages or not words or not any(map(str.isalpha, text)):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.values[list(map(self.at.__getitem__, words))].sum(0)
            best = int(total.argmax())
            langs.append(self.model.languages[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, the language's share of the probability, of whole texts.

    A null text, or one without a letter, is ``und`` with score 0.  Of languages that are equally likely the
    first by name is taken.  Repeated rows get equal results; columns of those names are replaced, others pass;
    an empty table gives an empty table.
    """
    columns = [c for c in df.columns if c not in ("lang_pred", "score")]
    shared, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # at most vocabulary x languages

    def run(batches):
        scorer = kept(("language", key), lambda: Scorer(shared.value))
        for batch in batches:
            for a, b, texts in in_slices(batch.column(columns.index(text)), 2 << 20):
                langs, scores = scorer.texts(texts)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])
        released()

    return df.select(*columns).mapInArrow(run, T.StructType([*(df.schema[c] for c in columns)]).add("lang_pred", "string").add("score", "double"))
