"""Sliding sums, extremes and order statistics against plain loops."""

import math
import random

import numpy as np


from tracewell.operators import sliding

KIND = "k string, sec bigint, n bigint, low bigint, high bigint, samples array<bigint>"
FRAMES = {"a": (10, 0), "b": (25, 10), "c": (1, 0), "d": (7, 7), "e": (100, 3)}


def rows(seed):
    rng = random.Random(seed)
    out = []
    for k in "xyz":
        for sec in sorted(rng.sample(range(-60, 200), rng.randint(1, 90))):
            samples = [rng.randint(0, 20) for _ in range(rng.choice([0, 0, 1, 3, 8]))]
            out.append((k, sec, len(samples), min(samples, default=None), max(samples, default=None), samples))
    return out


def test_frames(spark):
    for seed in range(3):
        given = rows(seed)
        df = spark.createDataFrame(given, KIND).repartition(3)
        out = sliding.with_extremes(sliding.with_sums(df, ["k"], ["n"], FRAMES), ["k"], "low", "high", FRAMES)
        out = sliding.with_quantiles(out, ["k"], "samples", FRAMES, {"p50": 0.5, "p95": 0.95, "p1": 1.0})
        got = out.collect()
        assert len(got) == len(given) and "samples" not in out.columns
        for r in got:
            for name, (a, b) in FRAMES.items():
                samples = sorted(s for k, sec, _, _, _, x in given if k == r.k and r.sec - a < sec <= r.sec - b for s in x)
                assert r[f"{name}_n"] == len(samples)
                assert (r[f"{name}_low"], r[f"{name}_high"]) == (min(samples, default=None), max(samples, default=None))
                for q, p in (("p50", 0.5), ("p95", 0.95), ("p1", 1.0)):
                    want = samples[max(1, math.ceil(len(samples) * p)) - 1] if samples else 0
                    assert r[f"{name}_{q}"] == want


def test_no_window_grows_back(spark):
    """Frames begin at the start of a partition, so that Spark adds rows to them and never sums one anew."""
    df = spark.createDataFrame(rows(9), KIND)
    plan = sliding.with_extremes(sliding.with_sums(df, ["k"], ["n"], FRAMES), ["k"], "low", "high", FRAMES)._jdf.queryExecution().toString()
    frames = [x for x in plan.split("specifiedwindowframe(")[1:]]
    assert frames and all(x.split(",")[1].strip().startswith("unboundedpreceding") for x in frames)
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_ranks():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 200):
        values = rng.integers(0, 9, n)
        low = rng.integers(0, n, 300)
        high = np.array([rng.integers(x + 1, n + 1) for x in low])
        k = np.array([rng.integers(0, b - a) for a, b in zip(low, high)])
        got = sliding.Ranks(values).smallest(low, high, k)
        assert got.tolist() == [sorted(values[a:b].tolist())[i] for a, b, i in zip(low, high, k)]
