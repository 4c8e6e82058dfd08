"""Toxicity: a counterfactual-regularised logistic classifier over words and word beginnings.

Features that a bounded labelled sample shows to go with the label are kept, and the identity terms always; a document
has a feature if any of its words has it, so a score doesn't drift with length. The fit adds a penalty: labelled sentences
are repeated with every identity term, and every neutral word, in the place of the one they name, or put in where they name
none, and the spread of the scores over these versions of a sentence is charged. Terms that merely stand near abuse, or
away from it, in the labels thereby lose their weight, and neutral mentions of a group score as if no group were named.
Scoring is one Arrow pass over whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, sliced, table
from letterloom.llm.labelled import fold, sample

THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
PREFIXES = (4, 5, 6)
#: A feature is kept if at least so many labelled texts have it and its log odds are so many standard errors above zero.
MIN_TEXTS, MIN_Z = 3, 3.0
RIDGE, COUNTERFACTUAL = 0.02, 100.0
#: Labelled sentences that are repeated with other terms, at most: those that name one first.
SENTENCES = 1000
#: A feature that so many texts of label 1 have, and hardly any other text, makes its sentences examples of their own.
SURE_TEXTS, SURE_SHARE = 10, 0.98

# Identity terms that the fit swaps, and the neutral words it swaps them for.
IDENTITY_TERMS = (
    "women men girls boys muslim muslims jewish jews christian christians hindu buddhist atheist black white asian "
    "african arab latino hispanic immigrant immigrants refugee refugees gay lesbian bisexual transgender queer straight "
    "disabled deaf blind elderly young old "
    "frauen männer muslime juden christen schwarze weiße asiaten afrikaner araber einwanderer flüchtlinge schwule lesben behinderte alte "
    "femmes hommes musulmans juifs chrétiens noirs blancs asiatiques africains arabes immigrés réfugiés gays lesbiennes handicapés vieux "
    "mujeres hombres musulmanes judíos cristianos negros blancos asiáticos africanos árabes inmigrantes refugiados lesbianas discapacitados ancianos"
).split()
NEUTRAL_TERMS = ("people", "leute", "gens", "personas")
_IDENTITY = frozenset(IDENTITY_TERMS)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(" ".join(set((text or "").lower().split()))))  # no word spans white space


def features_of(words: Iterable[str]) -> set[str]:
    """The words, and beginnings of the longer ones marked by a trailing asterisk."""
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def select(documents: Sequence[set[str]], y: np.ndarray) -> tuple[list[str], set[str]]:
    """Features that go with label 1, the clearest first; and those of them that are sure by themselves."""
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    with_1: Counter = Counter()
    with_0: Counter = Counter()
    for d, v in zip(documents, y):
        (with_1 if v else with_0).update(d)
    kept, sure = [], set()
    for f, a in with_1.items():
        if a < MIN_TEXTS:
            continue
        b = with_0[f]
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        error = np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
        if odds > MIN_Z * error:
            kept.append((-odds / error, f))
            if a >= SURE_TEXTS and a / n1 >= SURE_SHARE * (a / n1 + b / n0):
                sure.add(f)
    return [f for _, f in sorted(kept)], sure


def template_sentences(texts: Iterable[str], most: int = SENTENCES) -> list[set[str]]:
    """Words, identity terms left out, of labelled sentences: those that name a term first, in an order given by a hash."""
    best: dict[str, tuple[bool, int]] = {}
    bound = (True, 1 << 32)

    def first() -> list[tuple[str, tuple[bool, int]]]:
        return sorted(best.items(), key=lambda x: (x[1], x[0]))[:most]

    for text in texts:
        for s in _SENTENCE.split(text):
            if s not in best and (words := words_of(s)):
                key = (not (words & _IDENTITY), zlib.crc32(s.encode("utf-8", "replace")))
                if key <= bound:
                    best[s] = key
        if len(best) > 4 * most:  # few are held, however many the texts have
            best = dict(first())
            bound = max(best.values())
    return [words_of(s) - _IDENTITY for s, _ in first()]


class Counterfactuals:
    """The versions of sentences, each with one identity term or neutral word, and the charge on their scores' spread."""

    def __init__(self, sentences: Sequence[set[str]], number: dict[str, int]):
        own = [sorted(number[f] for f in features_of({t}) if f in number) for t in (*IDENTITY_TERMS, *NEUTRAL_TERMS)]
        self.at = np.array(sorted({i for x in own for i in x}), np.int64)  # the features that any term has
        place = {i: k for k, i in enumerate(self.at.tolist())}
        self.has = np.zeros((len(own), len(self.at)))
        for t, x in enumerate(own):
            self.has[t, [place[i] for i in x]] = 1
        rows = [sorted(number[f] for f in features_of(s) if f in number) for s in sentences]
        self.r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        self.c = np.array([i for x in rows for i in x], np.int64)
        self.lacks = np.ones((len(rows), len(self.at)))  # a feature that the sentence has already adds nothing
        for s, x in enumerate(rows):
            self.lacks[s, [place[i] for i in x if i in place]] = 0
        self.n = len(rows)

    def scores(self, w: np.ndarray, bias: float) -> np.ndarray:
        """One row for each sentence, one column for each term."""
        return sigmoid(bias + np.bincount(self.r, w[self.c], self.n)[:, None] + (self.lacks * w[self.at]) @ self.has.T)

    def spread(self, w: np.ndarray, bias: float) -> float:
        p = self.scores(w, bias)
        return float(np.square(p - p.mean(axis=1, keepdims=True)).mean())

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        """Of spread(), by the weights and the bias."""
        p = self.scores(w, bias)
        g = 2 / p.size * (p - p.mean(axis=1, keepdims=True)) * p * (1 - p)
        out = np.bincount(self.c, g.sum(axis=1)[self.r], len(w)).astype(np.float64)
        out[self.at] += ((g @ self.has) * self.lacks).sum(axis=0)
        return out, float(g.sum())


class ToxicityModel:
    def __init__(self, features: Sequence[str], weights: np.ndarray, bias: float):
        self.weights = dict(zip(features, weights.tolist()))
        self.bias = bias
        self.exact = frozenset(f for f in features if not f.endswith("*"))
        self.starts = {n: frozenset(f[:-1] for f in features if f.endswith("*") and len(f) == n + 1) for n in PREFIXES}

    def logit(self, text: str | None) -> float:
        words = words_of(text)
        z = self.bias + sum(self.weights[w] for w in sorted(self.exact & words))
        for n, starts in self.starts.items():
            if starts:
                found = starts & {w[:n] for w in words if len(w) > n}
                z += sum(self.weights[f + "*"] for f in sorted(found))
        return z

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        return sigmoid(np.array([self.logit(t) for t in texts], np.float64))


def fit_texts(texts: Sequence[str], y: Sequence[int], weight: Sequence[float], counterfactual: float = COUNTERFACTUAL, steps: int = 400, rate: float = 0.1) -> ToxicityModel:
    y, weight = np.asarray(y, np.float64), np.asarray(weight, np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel([], np.zeros(0), 0.0 if not len(y) else 4.0 if y[0] else -4.0)
    held: dict[str, str] = {}  # one string for each feature, whatever number of texts have it
    documents = [{held.setdefault(f, f) for f in features_of(words_of(t))} for t in texts]
    del held
    names, sure = select(documents, y)
    names += [t for t in IDENTITY_TERMS if t not in set(names)]
    number = {f: i for i, f in enumerate(names)}
    # A single sentence with a sure feature is as much an example as a text with many; together they weigh as the texts do.
    sentences = [d for t, v in zip(texts, y) if v for s in _SENTENCE.split(t) if not sure.isdisjoint(d := features_of(words_of(s)))]
    if sentences:
        documents += sentences
        weight = np.concatenate([weight, np.full(len(sentences), weight[y == 1].sum() / len(sentences))])
        y = np.concatenate([y, np.ones(len(sentences))])
    rows = [sorted(number[f] for f in d if f in number) for d in documents]
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.array([i for x in rows for i in x], np.int64)
    versions = Counterfactuals(template_sentences(texts) if counterfactual else [], number)
    least = np.array([-np.inf if f in _IDENTITY else 0.0 for f in names])  # other features speak for the label only, so that length can't speak against it
    w, bias = np.zeros(len(names)), float(np.log(np.average(y, weights=weight) / (1 - np.average(y, weights=weight))))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = bias + np.bincount(r, w[c], len(rows))
        d = (sigmoid(z) - y) * weight / len(y)
        g = np.bincount(c, d[r], len(names)) + RIDGE / len(y) * w
        slope = d.sum()
        if versions.n:
            charge, at_bias = versions.gradient(w, bias)
            g, slope = g + counterfactual * charge, slope + counterfactual * at_bias
        g = np.append(g, slope)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
        np.maximum(w, least, out=w)
    return ToxicityModel(names, w, bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", train=None, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model of at most 1,500 labelled texts of each class (see labelled.sample); the prior where labels lack a class."""
    train = train if train is not None else F.coalesce(fold("i", FOLDS) != HELD_OUT, F.lit(False))
    rows = sample(docs, labels, [label_col], [(0,), (1,)], train, id_col, text_col)
    return fit_texts([t for t, _, _ in rows], [int(y[0]) for _, y, _ in rows], [w for _, _, w in rows])


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, the probability of label 1 for the whole text.

    Null and empty texts score as a text without any feature. Repeated rows and null ids keep their rows, equal texts
    get equal scores, an empty table gives none, and other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield build(schema, [column(batch, "doc_id"), pa.array(model.scores(column(batch, "text").to_pylist()))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
