"""Centroid clustering of whole-number vectors, by sort-means.

Centroids are few (k is a parameter), so they go to every task. A vector is compared first
with the centroid of its former assignment, then with the others in order of their distance
from that one; the scan stops at the first that is farther than twice the vector's distance
to its former centroid, strictly, as one at exactly twice may be as near. Each round's
assignment is a table in the shared folder; the sums of the new centroids are made there, before anything is
shuffled, and one row a centroid comes to the driver.

Defined cases: vectors that are null, of another length, or with null or non-finite
components are left out; with fewer vectors than k there are so many centroids; equal rows
are vectors of their own, and of equal hashes the smaller vector seeds first; a null vec_id
has the decimal form ''; components beyond +-2^27 count as +-2^27, as squared distances
wouldn't fit a long otherwise; sums of distances that don't fit a long are null; an empty
table gives an empty result; only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written

MOST = 1 << 27
SCHEMA = "vec_id long, v array<long>, cluster int, distance long"


def whole_vectors(embeddings: DataFrame, size: int, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of the components, of vectors with size finite components."""
    given = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), given.alias("x")).where((F.size("x") == size) & F.forall("x", finite))
    clipped = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), x * scale))))).cast("long")
    return kept.select("vec_id", F.transform("x", clipped).alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the least SHA-256 of salt:vec_id, in that order."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), "UTF-8"), 256)
    return [list(r[0]) for r in vectors.select("v", digest.alias("h")).orderBy("h", "v").limit(k).select("v").collect()]


def nearest(vectors: np.ndarray, former: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each vector's nearest centroid, the smaller number at ties."""
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    best, distance = former.copy(), np.zeros(len(vectors), np.int64)
    for c in np.unique(former).tolist():
        at = np.flatnonzero(former == c)
        rows = vectors[at]
        from_former = ((rows - centroids[c]) ** 2).sum(1)
        near, number = from_former.copy(), np.full(len(at), c)
        # Twice a distance is four times its square; kept as a quotient, so that nothing leaves 63 bits.
        active = np.arange(len(at))
        for other in sorted((x for x in range(len(centroids)) if x != c), key=lambda x: (between[c, x], x)):
            active = active[-(-between[c, other] // 4) <= from_former[active]]
            if not len(active):
                break
            d = ((rows[active] - centroids[other]) ** 2).sum(1)
            better = (d < near[active]) | ((d == near[active]) & (other < number[active]))
            near[active[better]], number[active[better]] = d[better], other
        best[at], distance[at] = number, near
    return best, distance


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vectors (vec_id, v, cluster of before) with their nearest centroid and its squared distance."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(centroids, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column("v")
            flat = held.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            number, distance = nearest(flat, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), table)
            yield pa.record_batch([batch.column("vec_id"), held.cast(kinds[1]), pa.array(number, kinds[2]), pa.array(distance, kinds[3])], ["vec_id", "v", "cluster", "distance"])

    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, SCHEMA)


def moved(rows: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids at the floor of the mean of their vectors; those without any stay."""
    size = len(centroids[0])
    sums = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(size)])
    out = list(centroids)
    for r in sums.collect():  # one row a centroid
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(size)]
    return out


def clustered(embeddings: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, salt: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    rows = written(whole_vectors(embeddings, size, scale), "vectors").withColumn("cluster", F.lit(0))
    centroids = seeds(rows, k, salt)
    if not centroids:
        none = rows.where(F.lit(False))
        return none.select("vec_id", "cluster", *[F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for r in range(rounds):
        rows = written(assigned(rows, centroids), f"assigned-{r}")
        centroids = moved(rows, centroids)
    rows = written(assigned(rows, centroids).drop("v"), "clusters")
    totals = {r["cluster"]: int(r["t"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("t")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    told = [(c, fits(t), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, t in sorted(totals.items())]
    # One row a centroid: no more than k.
    table = embeddings.sparkSession.createDataFrame(told, "number int, cluster_inertia long, centroid_sha256 string")
    out = rows.join(F.broadcast(table), F.col("cluster") == F.col("number"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(fits(sum(totals.values()))).cast("long").alias("inertia"), "centroid_sha256")
