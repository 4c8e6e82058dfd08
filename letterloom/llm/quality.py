"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes become short fixed vectors (character class and a hash of the letter). Learned filters slide over
them; within overlapping chunks that cover the whole document each filter's response is max-pooled, and the chunks'
pooled responses are combined (largest, mean and smallest over the chunks, and the largest again in as far as a text
is shorter than a chunk) by a learned logistic layer into one probability. The smallest tells of a chunk that lacks
what ordinary text has, such as one that repeats a word.
Fitting takes a bounded sample on the driver; scoring is one Arrow pass over whole texts in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import build, column, sliced, table
from letterloom.llm.labelled import fold, sample

THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
FILTERS = 48
WIDTH = 16
#: A filter sees two steps of STEP bytes; a chunk is two halves of HALF bytes, so neighbours share a half.
STEP, HALF = 4, 256
#: Bytes convolved at a time.
BLOCK = 1 << 17
STEPS, BATCH, RATE = 800, 32, 0.01
SEED = 7


def byte_vectors() -> np.ndarray:
    """(256, WIDTH): one of eleven character classes, and five signs hashed from the byte; all zero for byte 0."""
    out = np.zeros((256, WIDTH), np.float32)
    classes = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",;:'\"()-", "!?", "#*$%&|<>@^_~=+/\\{}[]`")
    for b in range(1, 256):
        out[b, next((i for i, c in enumerate(classes) if chr(b) in c), 10)] = 1
        mixed = (b * 2654435761) & 0xFFFFFFFF
        out[b, 11:] = [0.5 if mixed >> (27 + i) & 1 else -0.5 for i in range(5)]
    return out


class ByteNet:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = byte_vectors()
        inputs = 2 * STEP * WIDTH
        self.params = {
            "w": (rng.standard_normal((inputs, FILTERS)) * (1.5 / np.sqrt(2 * STEP))).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "o": np.zeros(4 * FILTERS + 1, np.float32),
            "c": np.zeros(1, np.float32),
        }

    @staticmethod
    def laid_out(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts end to end, each padded with zeros to whole halves, and the halves of each."""
        halves = np.array([(len(t) + STEP + HALF - 1) // HALF for t in texts], np.int64)
        flat = np.zeros(int(halves.sum()) * HALF, np.uint8)
        at = np.concatenate([[0], np.cumsum(halves)]) * HALF
        for s, t in zip(at.tolist(), texts):
            flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
        return flat, halves

    @staticmethod
    def last_rows(halves: np.ndarray) -> np.ndarray:
        """The last step of each text, zeros all: its window would reach into the next text and is taken as zeros."""
        return np.cumsum(halves) * (HALF // STEP) - 1

    def windows(self, flat: np.ndarray) -> np.ndarray:
        """(positions + 1, STEP * WIDTH) inputs; a window is two rows that follow one another, the last row zeros."""
        return self.vectors[np.concatenate([flat, np.zeros(STEP, np.uint8)])].reshape(-1, STEP * WIDTH)

    def responses(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        w, k = self.params["w"], STEP * WIDTH
        z = x[:-1] @ w[:k]
        z += x[1:] @ w[k:]
        z[last] = 0
        z += self.params["b"]
        return np.maximum(z, 0, out=z)

    def pooled(self, flat: np.ndarray, halves: np.ndarray) -> np.ndarray:
        """Each half's largest responses, block by block."""
        out, last = [], self.last_rows(halves)
        for at in range(0, len(flat), BLOCK):
            end = min(at + BLOCK, len(flat))
            x = self.vectors[np.concatenate([flat[at:end], flat[end : end + STEP], np.zeros(STEP, np.uint8)])[: end - at + STEP]]
            own = last[np.searchsorted(last, at // STEP) : np.searchsorted(last, end // STEP)] - at // STEP
            out.append(self.responses(x.reshape(-1, STEP * WIDTH), own).reshape(-1, HALF // STEP, FILTERS).max(axis=1))
        return np.concatenate(out)

    @staticmethod
    def short(texts: Sequence[bytes]) -> np.ndarray:
        """The part of a whole chunk that each text lacks: 0 from two halves on."""
        return np.array([max(0.0, 1 - len(t) / (2 * HALF)) for t in texts], np.float32)

    @staticmethod
    def chunk_rows(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Left and right half of every chunk, and each document's first chunk."""
        chunks = np.maximum(halves - 1, 1)
        first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
        start = np.concatenate([[0], np.cumsum(halves)])[:-1]
        left = np.repeat(start - first, chunks) + np.arange(chunks.sum())
        return left, left + np.repeat((halves > 1).astype(np.int64), chunks), first

    def combined(self, halves_max: np.ndarray, halves: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right, first = self.chunk_rows(halves)
        chunk = np.maximum(halves_max[left], halves_max[right])
        n = np.maximum(halves - 1, 1)[:, None]
        most = np.maximum.reduceat(chunk, first)
        return chunk, np.hstack([most, np.add.reduceat(chunk, first) / n, np.minimum.reduceat(chunk, first), most * short[:, None], short[:, None]])

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.params["o"] + self.params["c"]

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        flat, halves = self.laid_out(texts)
        z = self.logits(self.combined(self.pooled(flat, halves), halves, self.short(texts))[1]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, texts: Sequence[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        flat, halves = self.laid_out(texts)
        x = self.windows(flat)
        last = self.last_rows(halves)
        a = self.responses(x, last).reshape(-1, HALF // STEP, FILTERS)
        place = a.argmax(axis=1)
        top = np.take_along_axis(a, place[:, None, :], 1)[:, 0]
        short = self.short(texts)
        chunk, features = self.combined(top, halves, short)
        p = 1 / (1 + np.exp(-np.clip(self.logits(features), -40, 40)))
        d = ((p - y) * weight / len(y)).astype(np.float32)
        out = {"o": features.T @ d + 1e-4 * self.params["o"], "c": np.array([d.sum()], np.float32)}
        left, right, first = self.chunk_rows(halves)
        n = np.maximum(halves - 1, 1)
        d_features = d[:, None] * self.params["o"][None, :]
        d_max, d_mean, d_min, d_short = np.split(d_features[:, :-1], 4, axis=1)
        d_max = d_max + d_short * short[:, None]
        d_chunk = np.repeat(d_mean / n[:, None], n, axis=0)
        for extreme, grad in ((np.argmax, d_max), (np.argmin, d_min)):
            for i, (s, e) in enumerate(zip(first, first + n)):
                d_chunk[s + extreme(chunk[s:e], axis=0), np.arange(FILTERS)] += grad[i]
        d_half = np.zeros_like(top)
        from_left = top[left] >= top[right]
        np.add.at(d_half, left, d_chunk * from_left)
        np.add.at(d_half, right, d_chunk * ~from_left)
        d_half *= top > 0
        rows = (np.arange(len(top))[:, None] * (HALF // STEP) + place).ravel()
        after = rows + 1
        after[np.isin(rows, last)] = len(x) - 1
        seen = np.concatenate([x[rows], x[after]], axis=1).reshape(len(top), FILTERS, -1)
        out["w"] = np.einsum("hf,hfd->df", d_half, seen, optimize=True)
        out["b"] = d_half.sum(axis=0)
        return out

    def fit(self, texts: Sequence[bytes], y: Sequence[int], weight: Sequence[float], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> ByteNet:
        """Adam on batches drawn evenly from the classes; the given weights keep the probabilities at the classes' true shares."""
        y, weight = np.asarray(y, np.float32), np.asarray(weight, np.float32)
        rng = np.random.default_rng(seed)
        groups = [np.nonzero(y == v)[0] for v in np.unique(y)]
        if len(groups) < 2:
            self.params["c"][:] = 0 if not len(groups) else (4 if y[0] else -4)
            return self
        share = np.array([weight[g].sum() for g in groups])
        share = share / share.sum() * len(groups)
        self.params["c"][:] = np.log(share[1] / share[0])
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.params.items()}
        for t in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, batch // len(groups)) for g in groups])
            w = np.concatenate([np.full(batch // len(groups), s, np.float32) for s in share])
            lr = rate * min(1, 2 * (1 - (t - 1) / steps))
            for k, g in self.gradients([texts[i] for i in pick], y[pick], w).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                self.params[k] -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
        return self


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train=None, id_col: str = "doc_id", text_col: str = "text") -> ByteNet:
    """A network fitted on at most 1,500 labelled texts of each class (see labelled.sample); the prior where labels lack a class."""
    train = train if train is not None else F.coalesce(fold("i", FOLDS) != HELD_OUT, F.lit(False))
    rows = sample(docs, labels, [label_col], [(0,), (1,)], train, id_col, text_col)
    return ByteNet().fit([t.encode("utf-8", "replace") for t, _, _ in rows], [int(y[0]) for _, y, _ in rows], [w for _, _, w in rows])


def _scores(net: ByteNet, texts: list[str | None], at_once: int = 1 << 19) -> np.ndarray:
    out, held, size = [], [], 0
    for t in texts:
        raw = (t or "").encode("utf-8", "replace")
        if held and size + len(raw) > at_once:
            out.append(net.score(held))
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    return np.concatenate([*out, net.score(held)])


def quality_scores(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, the probability of label 1 for the whole text.

    Null and empty texts get the score of an empty document. Repeated rows and null ids keep their rows, equal texts
    get equal scores, an empty table gives none, and other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield build(schema, [column(batch, "doc_id"), pa.array(_scores(net, column(batch, "text").to_pylist()))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, score double")


def keep_good(docs: DataFrame, net: ByteNet, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores below threshold; all columns, whatever their names, stay as they are.

    Null and empty texts are judged as an empty document. Equal texts, and so repeated rows, stay or go together; null
    ids make no difference; an empty table gives none.
    """

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            yield batch.filter(pa.array(_scores(net, column(batch, text_col).to_pylist()) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
