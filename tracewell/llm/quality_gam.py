"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins; shallow trees over the bins of one feature at a time are
boosted in turn (cyclic, small steps), so that each ends as a lookup table of additive
terms. Pairs of features are ranked by how much of what is left a coarse grid explains;
the best get tables of their own, boosted the same way. A score adds one entry per table.

Fit: on at most fit_rows labelled documents, the ones with the smallest hash of their id
(a documented bound of the sample); their features, not their texts, come to the driver.
Scoring covers every whole text in one Arrow pass without a shuffle.

Defined cases: null and empty texts have all features at zero and get the score that the
tables give; without labels of both kinds the score is the share of label 1, or 0.5
without labels; rows without a label or with a null id are not learnt from; equal rows get
equal scores; only id, text and the label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bytes_of, crc_remainder, slices
from tracewell.llm.features import NAMES, features


@dataclass
class Gam:
    """Tables over bins: one per feature, one per chosen pair on coarser bins."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        fine, coarse = self.bins(x, self.cuts), self.bins(x, self.coarse)
        out = np.full(len(x), self.intercept)
        for table, b in zip(self.tables, fine):
            out += table[b]
        for i, j, table in self.pairs:
            out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def quantile_cuts(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, n + 1)[1:-1], method="higher"))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree with few leaves over ordered bins, as a table."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            better = gain(cg[k] - cg[a], ch[k] - ch[a]) + gain(cg[b] - cg[k], ch[b] - ch[k]) - gain(cg[b] - cg[a], ch[b] - ch[a])
            at = int(better.argmax())
            if better[at] > best[0]:
                best = (float(better[at]), int(k[at]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over a grid: one cut of the rows, then one of the columns in either half."""
    best, out = -np.inf, np.zeros_like(g)
    rows_g, rows_h = np.cumsum(g, 0), np.cumsum(h, 0)
    for k in range(g.shape[0] - 1):
        total, parts = 0.0, []
        for half_g, half_h in ((rows_g[k], rows_h[k]), (rows_g[-1] - rows_g[k], rows_h[-1] - rows_h[k])):
            a, b = np.cumsum(half_g), np.cumsum(half_h)
            both = gain(a, b) + gain(a[-1] - a, b[-1] - b)
            at = int(both[:-1].argmax()) if len(both) > 1 else 0
            total += both[at]
            parts.append((at, -a[at] / (b[at] + 1.0), -(a[-1] - a[at]) / (b[-1] - b[at] + 1.0)))
        if total > best:
            best = total
            out = np.zeros_like(g)
            for rows, (at, left, right) in zip((slice(0, k + 1), slice(k + 1, None)), parts):
                out[rows, : at + 1], out[rows, at + 1 :] = left, right
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse_bins: int = 8, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.08, leaves: int = 3) -> Gam:
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    intercept = float(np.log(share / (1 - share)))
    cuts = [quantile_cuts(x[:, k], bins) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    coarse = [quantile_cuts(x[:, k], coarse_bins) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = Gam(cuts, [np.zeros(len(c) + 1) for c in cuts], intercept, coarse)
    if len(np.unique(y)) < 2:
        return model
    fine, rough = model.bins(x, cuts), model.bins(x, coarse)
    margin = np.full(len(y), intercept)
    for _ in range(rounds):
        for k, b in enumerate(fine):
            p = sigmoid(margin)
            n = len(cuts[k]) + 1
            step = rate * shallow_tree(np.bincount(b, p - y, n), np.bincount(b, p * (1 - p), n), leaves)
            model.tables[k] += step
            margin += step[b]
    p = sigmoid(margin)
    ranked = []
    for i in range(len(rough)):
        for j in range(i + 1, len(rough)):
            ni, nj = len(coarse[i]) + 1, len(coarse[j]) + 1
            cell = rough[i] * nj + rough[j]
            g, h = np.bincount(cell, p - y, ni * nj), np.bincount(cell, p * (1 - p), ni * nj)
            ranked.append((float(gain(g, h).sum()), i, j))
    model.pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(ranked, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in model.pairs:
            p = sigmoid(margin)
            cell = rough[i] * table.shape[1] + rough[j]
            g, h = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (p - y, p * (1 - p)))
            step = rate * grid_tree(g, h)
            table += step
            margin += step[rough[i], rough[j]]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, fit_rows: int) -> DataFrame:
    """text and y of at most fit_rows labelled documents outside the held-out part."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("y").isin(0, 1) & F.col("label_id").isNotNull() & (crc_remainder("label_id", modulus) != held))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(fit_rows)
    return docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, fit_rows: int = 20_000) -> Gam:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(bytes_of(part))
                yield pa.record_batch([*(pa.array(x[:, k]) for k in range(x.shape[1])), part.column("y")], [*NAMES, "y"])

    rows = training_rows(docs, labels, label, modulus, held, fit_rows)
    found = rows.mapInArrow(run, ", ".join(f"{n} double" for n in NAMES) + ", y int").toPandas()
    # Rows in an order of their own, so that the fit doesn't depend on that of tasks.
    found = found.sort_values([*NAMES, "y"], kind="stable")
    return fit_gam(found[NAMES].to_numpy(float).reshape(-1, len(NAMES)), found["y"].to_numpy(float))


def scored(docs: DataFrame, model: Gam, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array(shipped.value.score(features(bytes_of(part))))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (crc_remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    return scored(docs, fit(docs, labels, fit_rows=fit_rows))
