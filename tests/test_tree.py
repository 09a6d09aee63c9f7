"""Depths and critical paths against a walk, with long chains, orphans, cycles and repeated rows."""

import random
from datetime import datetime, timedelta

from tracewell.operators import tree

KIND = "trace_id string, span_id long, parent_span_id long, start_time timestamp, duration_us long"
T0 = datetime(2024, 1, 1)


def walk(rows):
    out = {}
    for t in {r[0] for r in rows}:
        own = {}
        for r in sorted(x for x in rows if x[0] == t):
            own.setdefault(r[1], r)
        children = {}
        for r in own.values():
            children.setdefault(r[2] if r[2] in own else None, []).append(r)
        stack = [(r, 0, r[1], True) for r in children.get(None, [])]
        while stack:
            r, depth, root, critical = stack.pop()
            out[t, r[1]] = depth, root, critical
            below = children.get(r[1], [])
            last = max(below, key=lambda x: (x[3] + timedelta(microseconds=x[4]), -x[1]), default=None)
            stack += [(x, depth + 1, root, critical and x is last) for x in below]
        for s in own:
            out.setdefault((t, s), (None, None, False))
    return out


def test_trees(spark):
    rng = random.Random(8)
    rows = [("chain", k, k - 1, T0 + timedelta(microseconds=k), 10) for k in range(1, 1001)]
    rows += [("wide", k, 0 if k == 1 else 1, T0, 5 if k % 2 else 9) for k in range(1, 400)]
    rows += [("cycle", 1, 3, T0, 1), ("cycle", 2, 1, T0, 1), ("cycle", 3, 2, T0, 1), ("cycle", 4, 3, T0, 1), ("cycle", 5, 0, T0, 1), ("cycle", 6, 6, T0, 1)]
    rows += [("orphan", 2, 77, T0, 1), ("orphan", 3, 2, T0, 1), ("orphan", 3, 2, T0, 1)]
    for t in range(30):
        n = rng.randint(1, 30)
        rows += [(f"t{t}", k, rng.randint(0, k - 1), T0 + timedelta(microseconds=rng.randint(0, 50)), rng.randint(0, 30)) for k in range(1, n + 1)]
    got = tree.depths(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    assert {(r.trace_id, r.span_id): (r.depth, r.root_id, r.critical) for r in got} == walk(rows)
    assert max(r.depth for r in got if r.depth is not None) == 999
    assert tree.depths(spark.createDataFrame([], KIND)).count() == 0
