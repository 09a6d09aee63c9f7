"""Toxicity: maximum-scoring segments of token log-odds.

Learning: Spark counts in how many labelled toxic and clean texts each word stands. The
log-odds of a word get a Dirichlet prior with the shares of both classes together (of
prior_share of all counts), and a z-score; words that stand out above min_z carry their log-odds, all others a small loss,
the average log-odds of the words of clean texts. A linear scan finds every segment that
no longer or shorter segment beats (all maximal scoring subsequences).

Calibration: in texts without toxicity, the best segment of n words follows an extreme
value distribution, P(S >= s) = 1 - exp(-K n exp(-lambda s)). lambda solves
sum p exp(lambda score) = 1 over the words of clean texts, K is fitted on clean training
texts. The segments that are significant by it are summed as evidence -log(expected
number), and two numbers fitted on training texts turn evidence into a probability.

The counts cover count_rows labelled training texts, those with the smallest hash of their
id (a documented bound of the sample, which is 16 bytes a row where it is sent). The lexicon that
goes to the executors has every word of that sample that stands out, so that the sample bounds it.

Defined cases: null and empty texts have no segment and the base score; without labels
of both kinds nothing is learnt and the score is the share of label 1 (or 0.5 without
labels); a null id is never learnt from; equal rows get equal scores; only id, text and
label are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bytes_of, crc_remainder, slices, written
from tracewell.llm.quality_gam import sigmoid

TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    loss: float = 0.05
    decay: float = 1.0  # lambda of the extreme value distribution
    scale: float = 0.1  # K
    slope: float = 0.0
    intercept: float = 0.0
    bound: float = 10.0
    level: float = 0.5  # expected number of chance segments below which one is significant


def maximal_segments(positions: np.ndarray, gains: np.ndarray, loss: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, stop, score) of tokens that cost loss, save for those with a gain.

    Only tokens with a gain are visited: a stack holds candidates with the cumulative score
    before and after each; a new one joins the nearest earlier one that starts lower and
    ends no higher (Ruzzo and Tompa's rule), so that the scan is linear.
    """
    total, last = 0.0, -1
    stack: list[list] = []  # first, stop, score before, score after
    for at, gain in zip(positions.tolist(), gains.tolist()):
        before = total - loss * (at - last - 1)
        total, last = before + gain, at
        new = [at, at + 1, before, total]
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
        stack.append(new)
    return [(a, b, after - before) for a, b, before, after in stack]


def evidence(model: Model, n_tokens: int, segments: list[tuple[int, int, float]]) -> float:
    """Sum of -log expected numbers of the significant segments; the best one's where none is.

    Beyond bound it grows with the logarithm, so that a few wrong labels can't bend the fit and
    more evidence still scores higher; it is held at minus bound.
    """
    if not segments:
        return -model.bound
    expected = [np.log(model.scale * max(n_tokens, 1)) - model.decay * s for _, _, s in segments]
    strong = [-e for e in expected if e < np.log(model.level)]
    found = float(sum(strong)) if strong else -min(expected)
    return max(found, -model.bound) if found <= model.bound else model.bound + float(np.log1p(found - model.bound))


class Scanner:
    """Segments of whole texts."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        tokens = TOKEN.findall(text.lower())
        get = self.model.weights.get
        hits = [(k, w) for k, w in enumerate(map(get, tokens)) if w is not None]
        if not hits:
            return len(tokens), []
        return len(tokens), maximal_segments(np.array([k for k, _ in hits]), np.array([w for _, w in hits]), self.model.loss)


def chosen_labels(labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """label_id and y of at most that many labelled rows outside the held-out part, the smallest hashes first."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & (crc_remainder("label_id", modulus) != held))
    return known.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(rows)


def labelled(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """text and y of the chosen rows; they are few enough to go to the texts, which stay where they are."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "y")


def word_counts(rows: DataFrame) -> DataFrame:
    """word, toxic, clean: in how many texts of either class a word stands; summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def drained() -> Iterator[pa.RecordBatch]:
            words = list({**counts[0], **counts[1]})
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield pa.record_batch([pa.array(some, pa.binary()), pa.array([counts[1][w] for w in some], pa.int64()), pa.array([counts[0][w] for w in some], pa.int64())], ["word", "toxic", "clean"])
            counts[0].clear()
            counts[1].clear()

        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for part in slices(batch, "text"):
                for text, y in zip(bytes_of(part), part.column("y").to_pylist()):
                    counts[y].update(set(TOKEN.findall(text.lower())))
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield from drained()
        yield from drained()

    return rows.select("text", "y").mapInArrow(run, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def lexicon(counts: DataFrame, totals: dict[str, int], prior_share: float, min_z: float) -> DataFrame:
    """word, weight and z of the words that stand out in toxic texts (log-odds with a Dirichlet prior)."""
    both = totals["toxic"] + totals["clean"]
    prior = prior_share * both
    a = F.col("toxic") + F.col("clean")
    alpha = prior * a / both
    odds = lambda n, total: F.log((n + alpha) / (total + prior - n - alpha))
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    weight = odds(F.col("toxic"), float(totals["toxic"])) - odds(F.col("clean"), float(totals["clean"]))
    found = counts.select("word", weight.alias("weight"), (weight / spread).alias("z"))
    return found.where(F.col("z") >= min_z)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, prior_share: float = 0.1, min_z: float = 4.5, count_rows: int = 40_000, fit_rows: int = 20_000) -> Model:
    """The model; lexicon from at most count_rows labelled texts, calibration from fit_rows of them."""
    chosen = chosen_labels(labels, label, modulus, held, count_rows)
    rows = labelled(docs, chosen)
    share = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    n, toxic = share["n"], share["y"] or 0
    base = (toxic + 0.5) / (n + 1.0)
    model = Model(intercept=float(np.log(base / (1 - base))))
    if not toxic or toxic == n:
        return model
    counts = written(word_counts(rows), "word-counts")
    totals = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first().asDict()
    if not totals["toxic"] or not totals["clean"]:
        return model
    words = lexicon(counts, totals, prior_share, min_z).toPandas()
    if not len(words):
        return model
    model.weights = {bytes(w): float(x) for w, x in zip(words["word"], words["weight"])}
    sample = labelled(docs, chosen_labels(labels, label, modulus, held, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = model.weights.get
        for batch in batches:
            for part in slices(batch, "text"):
                tokens = [TOKEN.findall(x.lower()) for x in bytes_of(part)]
                hits = [[(k, w) for k, w in enumerate(map(get, x)) if w is not None] for x in tokens]
                yield pa.record_batch(
                    [part.column("y"), pa.array([len(x) for x in tokens], pa.int64()), pa.array([[k for k, _ in x] for x in hits], pa.list_(pa.int64())), pa.array([[w for _, w in x] for x in hits], pa.list_(pa.float64()))],
                    ["y", "n", "at", "gain"],
                )

    found = sample.mapInArrow(run, "y int, n long, at array<long>, gain array<double>").toPandas().sort_values(["n", "y"], kind="stable")
    y, sizes = found["y"].to_numpy(float), found["n"].to_numpy(float)
    gains = [np.asarray(x, float) for x in found["gain"]]
    places = [np.asarray(x, np.int64) for x in found["at"]]
    # Scores of clean words: rare gains, and a loss that keeps the average below zero.
    clean = y == 0
    words_seen = float(sizes[clean].sum()) + 1.0
    clean_gains = np.concatenate([*(g for g, c in zip(gains, clean) if c), np.zeros(0)])
    model.loss = float(max(0.05, 4.0 * clean_gains.sum() / words_seen))
    model.decay = _decay(clean_gains, words_seen, model.loss, max(model.weights.values()))
    best = []
    for g, p in zip(gains, places):
        segments = maximal_segments(p, g, model.loss) if len(g) else []
        best.append(segments)
    # K by its moment: the mean of exp(lambda best) / n over clean texts, prior one chance hit in all.
    tops = np.array([max((s for _, _, s in x), default=0.0) for x in best])
    model.scale = float((np.minimum(np.exp(model.decay * tops[clean]), 1e6)[tops[clean] > 0].sum() + 1.0) / words_seen)
    x = np.array([evidence(model, int(k), s) for k, s in zip(sizes, best)])
    model.slope, model.intercept = _logistic(x, y)
    return model


def _decay(gains: np.ndarray, words: float, loss: float, most: float) -> float:
    """The positive root of sum p exp(lambda score) = 1; one word of the highest gain counts as seen."""
    gains = np.append(gains, most)
    low, high = 1e-6, 10.0
    total = lambda x: np.exp(np.minimum(x * gains, 600)).sum() / words + (1 - len(gains) / words) * np.exp(-x * loss)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return float(max(low, 1e-3))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a weak ridge."""
    beta = np.zeros(2)
    spread = max(float(np.std(x)), 1e-6)
    a = np.column_stack([x / spread, np.ones(len(x))])
    for _ in range(50):
        p = sigmoid(a @ beta)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-4])
        beta = beta + np.linalg.solve(h, a.T @ (y - p) - np.array([1e-2, 1e-4]) * beta)
    return float(beta[0] / spread), float(beta[1])


def scored(docs: DataFrame, model: Model, modulus: int = 5, held: int = 0, passages: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; with passages also its significant segments
    (first and stop word, score)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        scan = Scanner(model)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [scan(x) for x in bytes_of(part)]
                score = sigmoid(model.slope * np.array([evidence(model, n, s) for n, s in found]) + model.intercept)
                columns = [part.column("doc_id"), pa.array(score)]
                if passages:
                    limit = lambda n: (np.log(model.scale * max(n, 1)) - np.log(model.level)) / model.decay
                    columns.append(pa.array([[dict(zip(("first", "stop", "score"), s)) for s in x if s[2] > limit(n)] for n, x in found], kind))
                yield pa.record_batch(columns, ["doc_id", "score", "passages"][: len(columns)])

    schema = "doc_id long, score double" + ", passages array<struct<first:long,stop:long,score:double>>" * passages
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
    more = ["passages"] if passages else []
    return rows.select("doc_id", (crc_remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def toxicity_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    return scored(docs, fit(docs, labels, **settings))
