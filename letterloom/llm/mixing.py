"""Mixing sources to target weights with soft memberships.

A classifier fitted on a bounded sample of the labelled table gives every document a posterior over domains. A
document's rate is how many times it should enter the mix; rates that make the expected tokens of every domain
match its target are fitted by projected-gradient least squares over all documents and their unrounded posteriors.
A document's rate depends on its posterior and the steps alone, so the steps are what is kept: every iteration is one
distributed aggregate that walks them again, and only one row of domain sums comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from letterloom.llm.common import column, ddl_of, drop, sliced, table, written
from letterloom.llm.labelled import sample
from letterloom.llm.toxicity import ToxicityModel, fit_texts

#: Domains by the labels (quality, toxic), and the share of the mix's tokens that each should have.
DOMAINS = {"clean": (1, 0), "abusive": (1, 1), "junk": (0, 0), "junk_abusive": (0, 1)}
TARGETS = {"clean": 0.96, "abusive": 0.01, "junk": 0.02, "junk_abusive": 0.01}
ITERATIONS, TOLERANCE = 60, 1e-6

SHAPE = 7
_SYMBOLS, _CAPITALS, _STOPS = b"#*$%&|<>@^_~=+/\\{}[]", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".!?"


def shape_of(text: str | None) -> tuple[list[float], int]:
    """Shares that tell prose from junk, and the number of white-space words."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * SHAPE, 0

    def share(of: bytes, most: int) -> float:
        return min(1.0, (len(raw) - len(raw.translate(None, of))) / (most * n))

    again = sum(map(eq, words, words[1:]))
    return [share(_SYMBOLS, 2), share(_CAPITALS, 4), again / n, len(set(words)) / n, share(_STOPS, 1), min(1.0, n / 1000), 1.0 if n < 20 else 0.0], n


class DomainModel:
    """Multinomial logistic regression over the shape shares and the abuse model's logit."""

    def __init__(self, names: Sequence[str], weights: np.ndarray, abuse: ToxicityModel):
        self.names, self.weights, self.abuse = tuple(names), weights, abuse

    def inputs(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[int]]:
        shapes = [shape_of(t) for t in texts]
        logits = np.clip([self.abuse.logit(t) for t in texts], -8, 8) / 4
        x = np.array([[*s, z, 1.0] for (s, _), z in zip(shapes, logits)]).reshape(len(texts), SHAPE + 2)
        return x, [n for _, n in shapes]

    def posteriors(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[int]]:
        x, n = self.inputs(texts)
        z = x @ self.weights
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), n


def fit_domains(docs: DataFrame, labels: DataFrame, domains: Mapping[str, tuple] = DOMAINS, label_cols: Sequence[str] = ("quality", "toxic"), abuse_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", steps: int = 600) -> DomainModel:
    """A domain model fitted on at most 1,500 labelled texts of each domain (see labelled.sample). One input is the logit of an
    abuse model fitted to abuse_col, one of the label columns."""
    place, abuse = {tuple(v): i for i, v in enumerate(domains.values())}, list(label_cols).index(abuse_col)
    rows = [(t, place[y], w, y) for t, y, w in sample(docs, labels, list(label_cols), list(place), F.lit(True), id_col, text_col)]
    texts, weight = [r[0] for r in rows], np.array([r[2] for r in rows])
    model = DomainModel(list(domains), np.zeros((SHAPE + 2, len(domains))), fit_texts(texts, [int(r[3][abuse]) for r in rows], weight))
    if not rows:
        return model
    x, y = model.inputs(texts)[0], np.array([r[1] for r in rows])
    w = model.weights
    missing = np.array([i not in set(y.tolist()) for i in range(len(domains))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(len(domains))[y]
    for t in range(1, steps + 1):
        z = x @ w - 1e9 * missing
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ ((p - hot) * weight[:, None]) / len(y) + 1e-5 * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * min(1, 2 * (1 - (t - 1) / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    w[-1, missing] = -1e3  # a domain without labelled rows has no members
    return model


def memberships(docs: DataFrame, model: DomainModel, text_col: str = "text", keep: Sequence[str] | None = None, names: Sequence[str] = ("_shares", "_tokens")) -> DataFrame:
    """docs (or the columns to keep) with, under the names, the posterior of each domain, unrounded, and the white-space
    words added."""
    columns = list(docs.columns if keep is None else keep)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_col):
            p, n = model.posteriors(column(batch, text_col).to_pylist())
            shares = pa.array(p.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in columns), shares, pa.array(n, pa.int64())], names=[*columns, *names])

    return docs.mapInArrow(score, f"{ddl_of(docs, columns)}, `{names[0]}` array<double>, `{names[1]}` long")


def fit_rates(cells: DataFrame, targets: Sequence[float], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> tuple[list[tuple[float, ...]], np.ndarray, int]:
    """Projected gradient for: least sum over domains of (expected tokens - target)^2 / tokens held, every rate at least 0.

    cells(shares, tokens): documents with their posteriors. In the metric that weighs
    a document by its tokens the gradient of a rate is posterior . (residual / held), so from rates of one each step is rate =
    max(0, ahead - posterior . step), where ahead carries on the last change (Nesterov's acceleration); the division keeps
    small domains as quick to fit as large ones. Returns the steps (the vector and the next momentum), the reached shares
    of all tokens, and the tokens. The steps alone give any document its rate.
    """
    k = len(targets)
    total = int(cells.agg(F.sum("tokens")).first()[0] or 0)
    steps: list[tuple[float, ...]] = []
    if not total:
        return steps, np.zeros(k), 0
    p = [F.col("shares")[i] for i in range(k)]
    gram = cells.agg(*[F.sum(F.col("tokens") / total * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    gram = np.array(gram).reshape(k, k)
    held = np.maximum(gram.sum(axis=1), 1e-9)
    size = 1 / max(float(np.linalg.eigvalsh(gram / np.sqrt(np.outer(held, held)))[-1]), 1e-12)
    target, speed = np.asarray(targets, float), 1.0
    read = cells.select("shares", F.col("tokens").cast("double").alias("tokens"))
    names = [f"{which}{i}" for which in ("rate", "ahead") for i in range(k)]
    for at in range(iterations + 1):
        sums = read.mapInArrow(_expected(steps, k, total), ", ".join(f"{n} double" for n in names))
        reached, ahead = np.array(sums.agg(*[F.sum(n) for n in names]).first(), float).reshape(2, k)
        if at == iterations or np.abs(reached - target).max() <= tolerance:
            break
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        steps.append((*(size * (ahead - target) / held).tolist(), float((speed - 1) / faster)))
        speed = faster
    return steps, reached, total


def walked(p: np.ndarray, steps: Sequence[tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The rates and where the next step starts that the steps give to posteriors (one a row), starting from one."""
    rates, aheads = np.ones(len(p)), np.ones(len(p))
    for at in range(0, len(p), 4096):  # so many rows stay in the processor's cache
        part = p[at : at + 4096].T.copy()
        rate = ahead = np.ones(part.shape[1])
        for *s, momentum in steps:
            new = ahead.copy()
            for x, row in zip(s, part):
                new -= x * row
            np.maximum(new, 0.0, out=new)
            ahead = np.maximum(new + momentum * (new - rate), 0.0)
            rate = new
        rates[at : at + 4096], aheads[at : at + 4096] = rate, ahead
    return rates, aheads


def _expected(steps: Sequence[tuple[float, ...]], k: int, total: int):
    """Partial sums of the shares of all tokens that the steps' rates, and the next starts, give to each domain."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, k))
        for batch in batches:
            if batch.num_rows:
                p = column(batch, "shares").flatten().to_numpy().reshape(-1, k)
                weight = column(batch, "tokens").to_numpy() / total
                sums += [(weight * r) @ p for r in walked(p, steps)]
        names = [f"{which}{i}" for which in ("rate", "ahead") for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.ravel().tolist()], names=names)

    return add


def rate_of(shares, steps: Sequence[tuple[float, ...]], k: int):
    @F.arrow_udf("double")
    def rate(part: pa.Array) -> pa.Array:
        return pa.array(walked(part.flatten().to_numpy().reshape(-1, k), steps)[0])

    return rate(shares)


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, domains: Mapping[str, tuple] = DOMAINS, label_cols: Sequence[str] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", iterations: int = ITERATIONS, keep: Sequence[str] | None = None, abuse_col: str = "toxic") -> DataFrame:
    """docs (or its columns to keep) with _tokens, _shares and _rate added; the mix has as many expected tokens as docs.

    Targets of domains without members can't be met and are left out, the others scaled to one. Null and empty texts
    have no tokens and the posterior of an empty text. Repeated rows share a rate; null ids keep their rows; an empty
    table gives none. Columns of docs that have the added ones' names give way to them.
    """
    model = fit_domains(docs, labels, domains, label_cols, abuse_col, id_col, text_col)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("_shares", "_tokens", "_rate")]
    scored, _ = written(memberships(docs, model, text_col, kept))  # the texts are scored once
    light, path = written(scored.select(F.col("_shares").alias("shares"), F.col("_tokens").alias("tokens")))  # what every step reads
    k = len(domains)
    held = light.agg(*[F.sum(F.col("tokens") * F.col("shares")[i]) for i in range(k)]).first()
    wanted = np.array([targets[d] if (held[i] or 0) > 0 else 0.0 for i, d in enumerate(domains)])
    wanted = wanted / wanted.sum() if wanted.sum() else wanted
    steps, _, _ = fit_rates(light, wanted, iterations)
    drop(docs.sparkSession, path)
    return scored.withColumn("_rate", rate_of(F.col("_shares"), steps, k))


def copies(rate, *keys):
    """Whole copies of a document: the whole part of its rate, and one more in as many cases as the rest says."""
    draw = F.pmod(F.xxhash64(F.lit("mix"), *keys), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("key"))
    mixed = mix(docs, table(spark, sf_dir, "labels"), keep=["doc_id", "key"])
    posterior = [F.col("_shares")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return mixed.select("doc_id", F.col("_tokens").alias("n_tokens"), *posterior, F.col("_rate").alias("rate"), copies(F.col("_rate"), "doc_id", "key").alias("n_copies"))
