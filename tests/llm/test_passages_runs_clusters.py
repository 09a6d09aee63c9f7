"""Earlier passages, periodic runs and centroids against brute force, on odd rows and on empty tables."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tracewell.llm import centroids, lempel_ziv, tandem
from tracewell.llm.suffix import common_prefixes, nearest_after, nearest_before, suffix_order

SCHEMA = "doc_id long, text string, lang string, key string, spans string, h long"
RNG = random.Random(31)
ODD = [None, "", " \n\t", "a", "é " * 300, "Word " * 700, "x" * 1500, "one two", "\x00\x1f end", "a b   c"]
EMPTY = hashlib.sha256(b"").hexdigest()


def words_of(text):
    return (text or "").encode().split()


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "en", "clash", "clash", 1) for d, t in rows], SCHEMA).repartition(parts)


def corpus():
    """Prose of few words, shared passages of all lengths near the limit, edited and exact copies, a very common line."""
    prose = lambda n: " ".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") + RNG.choice("aeiou") for _ in range(n))
    passages = [prose(n) for n in (4, 5, 6, 7, 12, 13, 14, 30)]
    line = prose(9)
    texts = []
    for k in range(90):
        parts = [prose(RNG.randint(0, 40)), RNG.choice(passages), prose(RNG.randint(0, 5)), RNG.choice(passages), prose(RNG.randint(0, 40))]
        if k % 3 == 0:
            parts.insert(2, line)
        texts.append(RNG.choice([" ", "\n", "\t "]).join(parts))
    texts += [t.replace(" ", " X ", 1) for t in texts[:10]] + texts[:6] * 3 + ODD + ODD
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    ids[3] = ids[4] = None
    ids[7] = ids[8] = ids[9]
    return list(zip(ids, texts))


def brute_earlier(rows, window):
    big = 1 << 62
    first = {}
    for d, t in rows:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, big), big if d is None else d)
    out = []
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if d is None else d):
                gone |= set(range(k, k + window))
        out.append((str(d), len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window,hot_count", [(13, 2000), (13, 3), (6, 2000), (6, 10), (3, 5)])
def test_earlier_passages(spark, window, hot_count):
    rows = corpus()
    got = lempel_ziv.without_earlier(table(spark, rows, 5), window, hot_count).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_earlier(rows, window)
    assert sum(r.n_removed for r in got) > 500


def test_earlier_passages_of_an_empty_table(spark):
    out = lempel_ziv.without_earlier(table(spark, corpus()).limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_longest_earlier_pieces_and_their_parse():
    rng = np.random.default_rng(5)
    for turn in range(200):
        n, depth = int(rng.integers(1, 60)), 16
        symbols = rng.integers(0, 3, n)
        cuts = np.sort(rng.integers(0, n, 4))
        symbols[cuts] = 100 + np.arange(4)  # ends
        ids = rng.integers(0, 4, 5)[np.searchsorted(cuts, np.arange(n))]  # one a text
        got = lempel_ziv.longest_earlier(symbols, ids, depth)
        for i in range(n):
            most = 0
            for j in range(n):
                if ids[j] < ids[i]:
                    k = 0
                    while k < depth and max(i, j) + k < n and symbols[i + k] == symbols[j + k]:
                        k += 1
                    most = max(most, k)
            assert min(got[i], depth) == most
        window = int(rng.integers(1, 6))
        hit = set()
        for _, a, b in zip(*lempel_ziv.parsed(got, np.array([0]), np.array([n]), window)):
            hit |= set(range(a, b))
        assert hit == {x for i in range(n) if got[i] >= window for x in range(i, i + max(window, int(got[i])))}


def test_suffix_order_and_nearest():
    rng = np.random.default_rng(6)
    for turn in range(200):
        s = rng.integers(0, 1 + turn % 4, int(rng.integers(1, 50)))
        n = len(s)
        order, levels = suffix_order(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        for k, x in enumerate(common_prefixes(order, levels)[1:n].tolist(), 1):
            a, b = s[order[k - 1] :], s[order[k] :]
            m = min(len(a), len(b))
            assert x == (np.flatnonzero(np.append(a[:m] != b[:m], True))[0])
    for values in (rng.integers(0, 5, 300), np.arange(400), np.arange(400)[::-1], np.append(np.arange(300), [150, 3, 299, 0])):
        v = np.concatenate([[-1], values, [-1]])
        for equal in (False, True):
            want = [max((j for j in range(i) if v[j] < v[i] or (equal and v[j] == v[i])), default=-1) for i in range(1, len(v) - 1)]
            assert nearest_before(v[:-1], equal)[1:].tolist() == want
        want = [min(j for j in range(i + 1, len(v)) if v[j] < v[i]) for i in range(1, len(v) - 1)]
        assert nearest_after(v[1:])[:-1].tolist() == [x - 1 for x in want]


def brute_runs(s, least=6, times=4):
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b, q) for (a, b), q in out.items())


def brute_row(d, text):
    w = words_of(text)
    h = zlib.crc32(b"" if d is None else str(d).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute_runs(w)
    drop = {i for a, b, q in runs for i in range(a + q, b)}
    shown = "".join(f"{a},{b - a},{q}\n" for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = (None,) * 4
    for a, b, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best[0] is None or (b - a) * best[2] > best[1] * q:
            best = (a, b - a, q, 1000 * (b - a) // q)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return str(d), len(runs), *map(str, best), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_maximal_runs():
    for turn in range(2500):
        n, k = RNG.randint(0, 60), RNG.randint(1, 4)
        s = [RNG.randrange(k) for _ in range(n)]
        if turn % 2 and n:
            p, a = RNG.randint(1, max(1, n // 3)), RNG.randrange(n)
            for i in range(a + p, n):
                s[i] = s[i - p]
        for least, times in ((6, 4), (2, 2)):
            assert list(zip(*(x.tolist() for x in tandem.maximal_runs(np.array(s, np.int64), least, times)))) == brute_runs(s, least, times)


def test_periodic_runs(spark):
    texts = [" ".join(RNG.choice("abc") for _ in range(RNG.randint(1, 80))) for _ in range(300)] + ODD * 4
    rows = [(k if k != 4 else None, t) for k, t in enumerate(texts)]
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    for block in (5, 50_000):
        got = tandem.periodic_runs(table(spark, rows), block_words=block).collect()
        assert sorted((str(r.doc_id), r.n_runs, *(str(r[c]) for c in columns[1:5]), r.runs_sha256, r.collapsed_sha256) for r in got) == sorted(brute_row(*x) for x in rows)
    assert sum(r.n_runs > 0 for r in got) > 50
    assert tandem.periodic_runs(table(spark, rows).limit(0)).count() == 0


def test_long_repetitions_take_little_time(spark):
    began = time.perf_counter()
    texts = ["la " * 300_000, "do re mi " * 60_000, " ".join(f"{k} {k}" for k in range(100_000))]
    got = {r.doc_id: r for r in tandem.periodic_runs(table(spark, list(enumerate(texts)), 1), repeated=False).collect()}
    assert (got[0].length, got[0].period, got[1].length, got[1].period, got[2].n_runs) == (300_000, 1, 180_000, 3, 0)
    assert time.perf_counter() - began < 60


def brute_clusters(rows, k, rounds):
    kept = [(d, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for d, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for d, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), i) for i, x in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(x) // len(m) for x in zip(*m)] if m else old for m, old in zip(own, c)]
    last = [(d, *near(v)[::-1]) for d, v in kept]
    total = {i: sum(x for _, j, x in last if j == i) for i in range(len(c))}
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted((str(d), i, x, total[i], sum(total.values()), digest[i]) for d, i, x in last)


def test_clusters(spark):
    rng = np.random.default_rng(9)
    rows = [(k if k != 2 else None, [float(x) for x in rng.integers(-3, 4, 64) / 64 + 0.001 * (k % 3)]) for k in range(150)]
    rows += [(500 + k, [k % 2 / 64] * 64) for k in range(30)] + [(7, rows[7][1])] * 3  # ties and repeated rows
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63), (907, [2000.0] * 64), (908, [-0.001] * 64)]
    df = spark.createDataFrame([(d, v, "x", 1, "y") for d, v in rows], "vec_id long, embedding array<float>, v string, cluster int, label string").repartition(4)
    for k, rounds in ((16, 3), (3, 1), (5, 0), (400, 1)):
        got = centroids.clustered(df, k, rounds).collect()
        assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows, k, rounds)
    assert centroids.clustered(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], "vec_id long, embedding array<float>")
    assert {r.distance for r in centroids.clustered(huge).collect()} == {0}
    far = centroids.clustered(huge, 1, 1).collect()
    assert [r.distance for r in far] == [64 * centroids.MOST**2] * 2


def test_scan_stops_strictly_beyond_twice_the_distance():
    # Centroid 0 lies at exactly twice the distance from the former one, and is as near: the smaller number wins.
    table = np.array([[4], [0], [9]])
    number, distance = centroids.nearest(np.array([[2], [2], [7]]), np.array([1, 0, 1]), table)
    assert number.tolist() == [0, 0, 2] and distance.tolist() == [4, 4, 4]
