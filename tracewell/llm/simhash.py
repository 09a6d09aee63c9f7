"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at a small Hamming distance. Their bits are put into partitions, the
correlated ones together. If two fingerprints differ in at most t bits, then for any
thresholds t_i with sum(t_i + 1) = t + 1 they differ in at most t_i bits of some partition
i (-1: the partition isn't looked at). Dynamic programming picks the thresholds, and the
number of partitions, with the least estimated work: exact counts of equal values over all
fingerprints, their spread to near values by the bits' shares, and the number of probes.

All work is on different fingerprints, so that copies cost nothing. Buckets of more than
block_rows fingerprints are split into blocks, and every pair of blocks is compared: no
bucket meets in one task, no pair is lost. A task gives a spanning forest of the links it
finds, not all links; connected components join them.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and
link like any other; texts of fewer words than a shingle are one shingle; ties of a bit
(set in exactly half the hashes) give zero; a null doc_id is in its component but never
names it unless no member has an id; equal rows stay rows; an empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import components
from tracewell.llm.common import bytes_of, key_of, quoted, slices, text_key, unused, written

BITS = 64


def fingerprint_array(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """One unsigned 64-bit fingerprint per text."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split()
        n = len(words) - shingle + 1
        if n > 1:
            line = b" ".join(words)
            stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            first = [0, *stops[: n - 1].tolist()]
            hashes += [digest(line[a:b], seed) for a, b in zip(first, (stops[shingle - 1 :] - 1).tolist())]
        elif words:
            hashes.append(digest(b" ".join(words), seed))
        counts[k] = max(n, 1) if words else 0
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, text_key and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1_000_000):
                texts = bytes_of(part)
                found = fingerprint_array(texts, shingle, seed)
                yield pa.record_batch([part.column("doc_id"), pa.array([key_of(x) for x in texts], pa.binary()), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text_key binary, fp long")


@dataclass
class Partitioning:
    """Bits of each partition and the largest difference probed in it (-1: none)."""

    bits: list[list[int]]
    thresholds: list[int]

    def probes(self) -> list[tuple[int, int, list[int]]]:
        """(partition, mask of its bits, differences to probe) of the partitions in use."""
        out = []
        for k, (bits, t) in enumerate(zip(self.bits, self.thresholds)):
            flips = [sum(1 << b for b in some) for r in range(t + 1) for some in combinations(bits, r)]
            if t >= 0:
                out.append((k, sum(1 << b for b in bits), flips))
        return out


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, share of ones per bit, and correlation of bits, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + bits.T @ bits
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], ["n", "both"])

    parts = prints.select("fp").mapInArrow(run, "n long, both array<double>")
    sums = parts.select("n", F.posexplode("both").alias("at", "value")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toPandas().sort_values("at")
    if not len(sums):
        return 0, np.full(BITS, 0.5), np.zeros((BITS, BITS))
    n = int(sums["n"].iloc[0])
    joint = sums["value"].to_numpy().reshape(BITS, BITS) / max(n, 1)
    share = np.diag(joint)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    return n, share, (joint - np.outer(share, share)) / np.outer(spread, spread)


def grouped_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of near equal width, each grown by the bit most correlated with it."""
    strength = np.abs(correlation) - np.eye(len(correlation))
    left, out = list(range(len(strength))), []
    for k in range(parts):
        width = len(left) // (parts - k)
        mine = [max(left, key=lambda b: strength[b, left].sum())]
        left.remove(mine[0])
        while len(mine) < width:
            best = max(left, key=lambda b: strength[b, mine].sum())
            mine.append(best)
            left.remove(best)
        out.append(sorted(mine))
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Least total cost with sum(t_i + 1) = budget; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for k, more in enumerate(row):
                if used + k <= budget and (used + k not in step or cost + more < step[used + k][0]):
                    step[used + k] = (cost + more, [*chosen, k - 1])
        best = step
    return best[budget]


def plan_partitions(prints: DataFrame, distance: int, probe_cost: float = 4.0) -> Partitioning:
    """The partitions and thresholds with the least estimated candidates and probes."""
    n, share, correlation = bit_statistics(prints)
    layouts = {m: grouped_bits(correlation, m) for m in range(2, distance + 2)}
    names, keys = [], []
    for m, layout in layouts.items():
        for i, bits in enumerate(layout):
            names.append((m, i))
            keys.append(F.struct(F.lit(len(names) - 1).alias("p"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).alias("v")))
    counts = prints.select(F.explode(F.array(*keys)).alias("k")).groupBy("k").count()
    pairs = counts.groupBy("k.p").agg((F.sum(F.col("count").cast("double") * (F.col("count") - 1)) / 2).alias("pairs")).collect()
    equal = {names[r["p"]]: r["pairs"] for r in pairs}
    agree = share**2 + (1 - share) ** 2
    best = (np.inf, [], [])
    for m, layout in layouts.items():
        costs = []
        for i, bits in enumerate(layout):
            near = _at_most(1 - agree[bits], distance)
            row = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(bits), r) for r in range(t + 1))
                row.append(equal.get((m, i), 0.0) + n * n / 2 * (near[t] - near[0]) + probe_cost * max(n, 1) * probes)
            costs.append(row)
        cost, thresholds = allocate(costs, distance + 1)
        if cost < best[0]:
            best = (cost, layout, thresholds)
    return Partitioning(best[1], best[2])


def _at_most(p: np.ndarray, most: int) -> list[float]:
    """P(at most t of independent events), t = 0 .. most."""
    mass = np.zeros(most + 1)
    mass[0] = 1.0
    for x in p:
        mass[1:] = mass[1:] * (1 - x) + mass[:-1] * x
        mass[0] *= 1 - x
    return np.cumsum(mass).tolist()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def local_links(keys: np.ndarray, fps: np.ndarray, is_probe: np.ndarray, two_sided: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within groups of equal keys (rows are sorted by key)."""
    n = len(keys)
    label = np.arange(n)
    found_a, found_b = [], []
    at = np.arange(n - 1)
    step = 1
    while len(at):
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        other = at + step
        near = np.bitwise_count(fps[at] ^ fps[other]) <= distance
        near &= ~two_sided[at] | (is_probe[at] != is_probe[other])
        found_a.append(at[near])
        found_b.append(other[near])
        step += 1
    a, b = np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])
    while len(a):  # least label of each component, by hooking and halving
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    while True:
        up = label[label]
        if (up == label).all():
            break
        label = up
    child = np.flatnonzero(label != np.arange(n))
    return fps[child], fps[label[child]]


def links(prints: DataFrame, plan: Partitioning, distance: int, block_rows: int = 1024) -> DataFrame:
    """Edges (a, b) of fingerprints that join all pairs within the distance; prints holds different fingerprints."""
    index, probes = [], []
    for k, mask, flips in plan.probes():
        value = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        two_sided = F.lit(len(flips) > 1)
        if len(flips) > 1:
            index.append(F.struct(F.lit(k).alias("p"), value.alias("v"), two_sided.alias("two"), F.lit(False).alias("probe")))
        probes += [F.struct(F.lit(k).alias("p"), value.bitwiseXOR(F.lit(_signed(x))).alias("v"), two_sided.alias("two"), (two_sided if len(flips) > 1 else F.lit(False)).alias("probe")) for x in flips]
    rows = prints.select("fp", F.explode(F.array(*index, *probes)).alias("k")).select("fp", "k.*")
    sizes = rows.groupBy("p", "v").agg(F.count(F.lit(1)).alias("n"))
    # Buckets of one row hold no pair; large ones are cut into blocks by the fingerprint's hash.
    many = sizes.where("n > 1").select(F.col("p").alias("bp"), F.col("v").alias("bv"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    placed = rows.join(many, (F.col("p") == F.col("bp")) & (F.col("v") == F.col("bv"))).select("fp", "p", "v", "two", "probe", "blocks")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("block", block).withColumn("other", other).withColumn("key", F.xxhash64("p", "v", F.least("block", "other"), F.greatest("block", "other")))
    dealt = dealt.select("key", "fp", "two", "probe").repartition("key").sortWithinPartitions("key", "fp", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [np.concatenate(x) for x in zip(held, _columns(batch))] if held is not None else _columns(batch)
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            yield from _linked([x[:cut] for x in now], distance)
            held = [x[cut:] for x in now]
        if held is not None:
            yield from _linked(held, distance)

    return dealt.mapInArrow(run, "a long, b long")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(x).to_numpy(zero_copy_only=False) for x in ("key", "fp", "probe", "two")]


def _linked(columns: list[np.ndarray], distance: int, rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """Links of whole keys, some thousand rows at a time. Keys are hashes: a clash only adds comparisons."""
    key, fp, probe, two = columns
    a = 0
    while a < len(key):
        b = min(a + rows, len(key))
        if b < len(key):
            start = int(np.searchsorted(key[a:b], key[b], "left")) + a
            b = start if start > a else int(np.searchsorted(key, key[a], "right"))
        child, root = local_links(key[a:b], fp[a:b].astype(np.int64).view(np.uint64), probe[a:b], two[a:b], distance)
        yield pa.record_batch([pa.array(child.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])
        a = b


def classified(docs: DataFrame, distance: int, shingle: int, seed: int) -> DataFrame:
    """doc_id, text_key, fp, root (a fingerprint that names the component) and component_id of every row."""
    rows = written(fingerprints(docs, shingle, seed), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("head")), "different-fingerprints")
    edges = links(prints, plan_partitions(prints, distance), distance)
    joined = components.roots(edges)
    member = prints.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("head").alias("component_id"))
    # Only components of several fingerprints need another name than their own head.
    other = member.where("root <> fp").select("fp", F.col("root").alias("r")).unionAll(joined.select(F.col("root").alias("fp"), F.col("root").alias("r")).distinct())
    names = other.join(named, F.col("r") == F.col("root")).select(F.col("fp").alias("member"), "root", "component_id")
    classes = prints.join(names, F.col("fp") == F.col("member"), "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "head").alias("component_id"))
    return rows.join(written(classes, "classes"), F.col("fp") == F.col("class_fp")).drop("class_fp")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    return classified(docs, distance, shingle, seed).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The documents with one row of each component kept, one with the least doc_id; their columns as they are.

    Rows are told apart by doc_id and text, components by their fingerprints: null ids and ids
    that different texts share lose nothing. Among rows of the least id the first by text_key
    stays; null ids come last; of rows with equal id and text one stays.
    """
    found = classified(docs, distance, shingle, seed).groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("x")
    head_id, head_key, many, key, row = unused(docs.columns, "head_id", "head_key", "many", "key", "row")
    heads = written(found.groupBy("root").agg(first).select(F.col("x.doc_id").alias(head_id), F.col("x.text_key").alias(head_key), F.col("x.n").alias(many)), "heads")
    same = (text_key() == F.col(head_key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(head_id))
    single = docs.join(heads.where(F.col(many) == 1), same, "left_semi")
    several = docs.join(heads.where(F.col(many) > 1), same, "left_semi")
    least = several.groupBy(text_key().alias(key), F.col("doc_id").alias(head_id)).agg(F.min(F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])).alias(row))
    return single.unionAll(least.select(*[F.col(f"{row}.c{k}").alias(c) for k, c in enumerate(docs.columns)]))
