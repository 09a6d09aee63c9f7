"""Sharding by balanced label propagation.

Documents with equal texts are linked. Members of a group are alike, so that the state of
the propagation is one row per group with its number of members in each shard, whatever
the group's size. Groups of a quarter of a shard or more, at most four a shard, are seeded:
the largest first, each in as few shards as can hold it. The others start dealt round.

Each round, members of a group want to move to the shard where most of the group is. Wishes
that form cycles of shards are exchanged, which needs no free place; what is left fills free
places. A join with the table of quotas picks the moves: per pair of shards those with the
highest gain in uncut edges; of a class that doesn't fit, as many members as there is room
for. At the end documents are dealt to the places of their group, and those without
links fill what is left, so that counts differ by at most one (law rows).

A quota table has one row per pair of shards, gain class and hash class; only it goes to
the driver. Positions within groups and shards come from two-level counts (chunks of some
ten thousand rows), so that no group and no shard meets in one task.

Defined cases: null and empty texts are equal to each other and have size 1; a null doc_id
is placed like any other; equal rows keep a place each; an empty table gives an empty
result; fewer documents than shards leave shards empty; only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import text_of, written

GAINS = 32  # classes of gain, by powers of two
SPLITS = 64  # classes of the group's hash within a class of gain


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and grp (the SHA-256 of the text)."""
    utf8 = F.encode(text_of(), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"),
        F.unhex(F.sha2(utf8, 256)).alias("grp"),
    )


def numbered(df: DataFrame, keys: list[str], order: list[Column], chunks: int, name: str) -> DataFrame:
    """df with a gapless number from 0 within the keys.

    Rows are hashed to chunks; each chunk is numbered by itself and starts after the rows
    of the chunks before it. A key's chunk counts, not its rows, meet in one task.
    """
    chunk = F.pmod(F.xxhash64(order[-1]), F.lit(chunks)).cast("int")
    cut = df.withColumn("_chunk", chunk)
    counts = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    # Dealt by key and chunk even where df is dealt by the key already (after a join), so that a hot key is spread.
    local = cut.repartition(*keys, "_chunk").withColumn("_local", F.row_number().over(own) - 1)
    return local.join(starts, [*keys, "_chunk"]).withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_chunk", "_start", "_local")


def seeded(large: list[tuple[bytes, int]], quotas: list[int]) -> tuple[list[tuple[bytes, list[int]]], list[int]]:
    """(group, counts per shard) of the large groups, each in as few shards as it can be, and the places left."""
    free, out = list(quotas), []
    for grp, members in sorted(large, key=lambda x: (-x[1], x[0])):
        counts = [0] * len(free)
        while members:
            s = min(range(len(free)), key=lambda s: (free[s] < members, free[s] if free[s] >= members else -free[s], s))
            n = min(members, free[s])
            counts[s], free[s], members = counts[s] + n, free[s] - n, members - n
        out.append((grp, counts))
    return out, free


def flows(wanted: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (s, t) go ahead, so that no shard gets more than its free places.

    Cycles are exchanged until none is left. Then each shard is filled after those that its
    own members leave for.
    """
    left, out, free = {k: n for k, n in wanted.items() if n}, defaultdict(int), list(free)

    def go(edge: tuple[int, int], n: int) -> None:
        out[edge] += n
        left[edge] -= n
        if not left[edge]:
            del left[edge]

    def search() -> tuple[list[tuple[int, int]], list[int]]:
        """Edges of a cycle, or none and the shards so that each comes after its targets."""
        after = defaultdict(list)
        for s, t in sorted(left):
            after[s].append(t)
        done: list[int] = []

        def walk(s: int, path: list[int]) -> list[int]:
            if s in path:
                return [*path[path.index(s) :], s]
            if s in done:
                return []
            for t in after[s]:
                if found := walk(t, [*path, s]):
                    return found
            done.append(s)
            return []

        for s in range(len(free)):
            if found := walk(s, []):
                return list(zip(found, found[1:])), []
        return [], done

    for s, t in sorted(left):
        if (s, t) in left and (t, s) in left:
            n = min(left[s, t], left[t, s])
            go((s, t), n)
            go((t, s), n)
    cycle, order = search()
    while cycle:
        n = min(left[e] for e in cycle)
        for e in cycle:
            go(e, n)
        cycle, order = search()
    for t in order:
        for s in range(len(free)):
            n = min(left.get((s, t), 0), free[t])
            if n:
                go((s, t), n)
                free[t], free[s] = free[t] - n, free[s] + n
    return dict(out)


def propagate(groups: DataFrame, quotas: list[int], shards: int, rounds: int) -> DataFrame:
    """Groups (grp, counts array per shard) after the moves; never more than quotas[s] members in shard s."""
    state = groups
    for turn in range(rounds):
        used = state.select(F.posexplode("counts").alias("s", "n")).groupBy("s").agg(F.sum("n").alias("n")).collect()
        free = list(quotas)
        for r in used:
            free[r["s"]] -= r["n"]
        most = F.array_max("counts")
        # The target is the shard with most members; among equals one by the group's hash, another each round, as what had no counterpart may find one.
        ties = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.element_at("counts", s + 1) == F.element_at("counts", F.array_position("counts", F.array_max("counts")).cast("int")))
        wish = state.withColumn("t", F.element_at(ties, F.pmod(F.xxhash64("grp", F.lit(turn)), F.size(ties)).cast("int") + 1)).withColumn("most", most)
        moves = wish.select("grp", "t", "most", F.posexplode("counts").alias("s", "n")).where("n > 0 AND s <> t")
        # Uncut edges gained by moving n members to m others: n * m; its class is the power of two.
        moves = moves.withColumn("gain", F.least(F.lit(GAINS - 1), F.floor(F.log2(F.col("n").cast("double") * F.col("most"))).cast("int"))).withColumn("split", F.pmod(F.xxhash64("grp", "s"), F.lit(SPLITS)).cast("int"))
        wanted = moves.groupBy("s", "t", "gain", "split").agg(F.sum("n").alias("n")).collect()
        pairs: dict[tuple[int, int], int] = defaultdict(int)
        for r in wanted:
            pairs[r["s"], r["t"]] += r["n"]
        room, allowed = flows(pairs, free), []
        for r in sorted(wanted, key=lambda r: (-r["gain"], r["split"], r["s"], r["t"])):
            n = min(r["n"], room.get((r["s"], r["t"]), 0))
            if n:
                room[r["s"], r["t"]] -= n
                allowed.append((r["s"], r["t"], r["gain"], r["split"], n, n == r["n"]))
        if not allowed:
            break
        # At most shards**2 * GAINS * SPLITS rows, some 16 MB, whatever the input.
        quota = state.sparkSession.createDataFrame(allowed, "s int, t int, gain int, split int, room long, whole boolean")
        picked = moves.join(F.broadcast(quota), ["s", "t", "gain", "split"])
        # One class of a pair of shards is moved in part: its groups in turn, until the room is used.
        before = F.coalesce(F.sum("n").over(Window.partitionBy("s", "t", "gain", "split").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        part = picked.where("NOT whole").withColumn("take", F.least("n", F.col("room") - before)).where("take > 0")
        taken = picked.where("whole").withColumn("take", F.col("n")).select("grp", "t", "s", "take").unionAll(part.select("grp", "t", "s", "take"))
        going = taken.groupBy("grp", "t").agg(F.sum("take").alias("moved"), F.map_from_entries(F.collect_list(F.struct("s", "take"))).alias("left")).select(F.col("grp").alias("g"), F.col("t").alias("to"), "moved", "left")
        joined = state.join(going, F.col("grp") == F.col("g"), "left")
        at = F.sequence(F.lit(0), F.lit(shards - 1))
        changed = F.transform(at, lambda s: F.element_at("counts", s + 1) + F.when(s == F.col("to"), F.col("moved")).otherwise(-F.coalesce(F.try_element_at("left", s), F.lit(0).cast("long"))))
        state = written(joined.select("grp", F.when(F.col("to").isNull(), F.col("counts")).otherwise(changed).alias("counts")), "shard-groups")
    return state


def dealt_round(free: list[int]) -> list[Column]:
    """Per shard, how many of the places first .. first + members - 1 it has, when places are dealt round among the shards that still have some."""
    shares = [F.lit(0).cast("long") for _ in free]
    level = start = 0
    for top in sorted(set(free) - {0}):
        some = [s for s, n in enumerate(free) if n >= top]
        size = (top - level) * len(some)
        a, b = (F.least(F.greatest(x - start, F.lit(0)), F.lit(size)) for x in (F.col("first"), F.col("first") + F.col("members")))
        for k, s in enumerate(some):
            shares[s] = shares[s] + F.floor((b + (len(some) - 1 - k)) / len(some)) - F.floor((a + (len(some) - 1 - k)) / len(some))
        level, start = top, start + size
    return [x.cast("long") for x in shares]


def sharded(docs: DataFrame, shards: int = 16, rounds: int = 6, chunk_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    # uid tells equal rows apart; it is stored once, so that later stages and retries agree on it.
    rows = written(measured(docs).withColumn("uid", F.monotonically_increasing_id()), "shard-rows")
    total = rows.count()
    chunks = max(1, ceil(total / chunk_rows))
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))
    groups = written(sizes.where("members > 1"), "linked-groups")
    least = max(2, ceil(quotas[0] / 4))
    # At most 4 * shards groups are that large.
    large, free = seeded([(bytes(r["grp"]), r["members"]) for r in groups.where(F.col("members") >= least).collect()], quotas)
    # First places of the others: all linked rows in a row, dealt round; group g has its rows first .. first + members - 1.
    linked = numbered_sums(groups.where(F.col("members") < least), chunks)
    start = linked.select("grp", F.array(*dealt_round(free)).alias("counts"))
    state = propagate(written(start, "shard-groups"), free, shards, rounds)
    state = state.unionAll(docs.sparkSession.createDataFrame(large, "grp binary, counts array<long>"))
    used = {r["s"]: r["n"] for r in state.select(F.posexplode("counts").alias("s", "n")).groupBy("s").agg(F.sum("n").alias("n")).collect()}
    left = [quotas[s] - used.get(s, 0) for s in range(shards)]

    # Salt: rows of one group are numbered over chunks, so a group of any size is spread.
    keyed = rows.join(state.select(F.col("grp").alias("g"), "counts"), F.col("grp") == F.col("g"), "left").drop("g")
    order = [F.col("doc_id"), F.col("uid")]
    in_groups = numbered(keyed.where("counts IS NOT NULL"), ["grp"], order, chunks, "rank")
    ends = F.aggregate("counts", F.array().cast("array<long>"), lambda done, n: F.concat(done, F.array(n + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("long")))))
    in_groups = in_groups.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("rank"))))
    alone = numbered(keyed.where("counts IS NULL").withColumn("one", F.lit(0)), ["one"], order, chunks, "rank")
    stops, at = [], 0
    for n in left:
        at += n
        stops.append(at)
    shard = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        shard = F.when(F.col("rank") < stops[s], F.lit(s)).otherwise(shard)
    columns = ["doc_id", "size", "text_crc32", "uid", "shard"]
    placed = written(in_groups.select(*columns).unionAll(alone.withColumn("shard", shard).select(*columns)), "placed")
    out = numbered(placed, ["shard"], order, chunks, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered_sums(groups: DataFrame, chunks: int) -> DataFrame:
    """Groups with first, the number of members of all groups before them."""
    cut = groups.withColumn("_chunk", F.pmod(F.xxhash64("grp"), F.lit(chunks)).cast("int"))
    counts = cut.groupBy("_chunk").agg(F.sum("members").alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per chunk of some ten thousand documents meets here.
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("_chunk").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("members").over(own), F.lit(0)))
    return local.join(starts, "_chunk").select("grp", "members", (F.col("_start") + F.col("_local")).alias("first"))
