"""Personal data by weak supervision, in DataFrame and SQL expressions alone.

Base spans come from four patterns with their checks. Further candidates (credentials and
national phone numbers) are voted on by labelers: shape patterns, a gazetteer of key
prefixes, words in the context, mixture and length. Expectation-maximisation over the
counts of vote patterns (a table of bounded size, summed by Spark over all documents)
estimates how reliable each labeler is; its posteriors train a logistic classifier over
shape features, and the spans that it accepts are added to the base spans.

A pattern's matches and the pieces between them give the offsets: a match starts where
the lengths of all pieces and matches before it end. Patterns start only at the begin of a
run or where the last match ended and are possessive, so that long runs take linear time;
what they match is the same as for the plain patterns. Lists are folded in chunks, and
long texts are cut into blocks before pieces are taken out of them: an array that grows by
one copies itself each time, and a substring counts code points from the text's begin.

Defined cases: null and empty texts have no spans; equal rows get equal results; without
candidates nothing is learnt and nothing added; offsets are code points, end exclusive;
only doc_id and text are read (redaction passes other columns through, whatever their
names, as one struct).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import quoted, written

KINDS = ["email", "ip", "card", "phone", "secret", "national"]
LOCAL = "A-Za-z0-9._%+-"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{12,}+",
    "national": r"(?<![0-9+.)-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9])",
}
#: Cheap tests that every text with a match of the kind passes.
HINTS = {
    "email": "contains(t, '@')",
    "ip": r"rlike(t, r'[0-9]\.[0-9]')",
    "card": r"rlike(t, r'[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]')",
    "phone": "contains(t, '+')",
    "secret": r"rlike(t, r'[A-Za-z][0-9]|[0-9][A-Za-z]')",
    "national": "contains(t, '(')",
}
LUHN = """aggregate(sequence(1, length(d)), 0, (s, i) -> s + CASE
    WHEN i % 2 = 1 THEN int(substring(d, -i, 1))
    WHEN int(substring(d, -i, 1)) > 4 THEN 2 * int(substring(d, -i, 1)) - 9
    ELSE 2 * int(substring(d, -i, 1)) END) % 10 = 0"""
DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
CHECKS = {
    "email": "true",
    "ip": rf"rlike(x.m, r'^{OCTET}(?:\.{OCTET}){{3}}$')",
    "card": f"exists(array({DIGITS}), d -> length(d) BETWEEN 12 AND 19 AND {LUHN})",
    "phone": f"length({DIGITS}) BETWEEN 9 AND 15",
}
CONTEXT = 32  # code points before a candidate that the context labeler reads

#: Votes of the labelers: 1 for, -1 against, 0 no opinion. x.m is the span, x.c its context.
MIXED = "length(regexp_replace(regexp_replace(x.m, '[A-Za-z]+', 'a'), '[0-9]+', '0'))"
LABELERS = {
    "shape": r"CASE WHEN x.kind = 4 THEN CASE WHEN rlike(x.m, r'^(?:[0-9a-f]{18,}|[A-Z]{3,5}[0-9A-Z]{12,})$') THEN 1 WHEN rlike(x.m, r'^[A-Za-z]+[0-9]{1,2}$') THEN -1 ELSE 0 END ELSE 1 END",
    "gazetteer": r"CASE WHEN x.kind = 4 AND rlike(x.m, r'^(?:AKIA|ASIA|AIza|ghp|gho|xox|sk|pk|rk)') THEN 1 WHEN x.kind = 5 AND rlike(x.m, r'^\((?:800|888|877|866|900)\)') THEN -1 ELSE 0 END",
    "context": r"CASE WHEN rlike(x.c, r'(?i)(?:pass(?:word|wd|phrase)?|token|secret|api.?key|pwd|bearer|auth)[\x22\x27\s]*[=:]?[\x22\x27\s]*$') OR x.kind = 5 AND rlike(x.c, r'(?i)(?:tel|phone|call|fax|mobile)[.:\s]*$') THEN 1 WHEN rlike(x.c, r'(?i)(?:isbn|version|figure|section)[\s.:#]*$') THEN -1 ELSE 0 END",
    "mixture": f"CASE WHEN x.kind = 5 THEN 0 WHEN {MIXED} >= 5 THEN 1 WHEN {MIXED} <= 2 THEN -1 ELSE 0 END",
    "length": "CASE WHEN x.kind = 5 THEN 0 WHEN length(x.m) >= 16 THEN 1 WHEN length(x.m) < 14 THEN -1 ELSE 0 END",
}
#: Features of the span classifier, each 0 or 1, besides the constant.
FEATURES = {
    "is_secret": "x.kind = 4",
    "long": "length(x.m) >= 16",
    "very_long": "length(x.m) >= 32",
    "mixed": f"{MIXED} >= 4",
    "many_runs": f"{MIXED} >= 7",
    "upper_only": "NOT rlike(x.m, '[a-z]')",
    "lower_only": "NOT rlike(x.m, '[A-Z]')",
    "hex": "rlike(x.m, '^[0-9a-f]+$')",
    "assigned": r"rlike(x.c, r'[=:]\s*[\x22\x27]?$')",
    "after_space": r"rlike(x.c, r'(?:^|\s)$')",
}


def _found(kind: str) -> dict[str, Column]:
    """Matches of a kind and the pieces between them."""
    empty = "cast(array() AS array<string>)"
    pattern = PATTERNS[kind]
    return {
        f"m_{kind}": F.expr(f"CASE WHEN {HINTS[kind]} THEN regexp_extract_all(t, r'{pattern}', 0) ELSE {empty} END"),
        f"p_{kind}": F.expr(f"CASE WHEN {HINTS[kind]} THEN split(t, r'{pattern}', -1) ELSE {empty} END"),
    }


CHUNK = 128  # list entries folded at a time
BLOCK = 4096  # code points of a text block


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with name standing for value.

    What stands in a lambda is worked out at each element, columns that the planner merges
    in included; a lambda's own variable is not.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chunked(items: str) -> str:
    """SQL of a list of lists: items, of which there is at least one, in chunks and in order."""
    return _let("whole", items, f"transform(sequence(0, int(size(whole) - 1) div {CHUNK}), j -> slice(whole, j * {CHUNK} + 1, {CHUNK}))")


def _folded(chunks: str, kind: str, pos: str, item: str, done: str) -> str:
    """SQL of a fold over chunks whose state is a position a.pos and a growing list.

    For each x, pos gives the next position and item a list of what is added to the list (of kind).
    done: what comes of the end state r (r.pos, r.done).
    """
    inner = f"aggregate(chunk, struct(acc.pos AS pos, cast(array() AS array<{kind}>) AS done), (a, x) -> struct({pos} AS pos, concat(a.done, {item}) AS done))"
    step = _let("i", inner, "struct(i.pos AS pos, concat(acc.done, array(i.done)) AS done)")
    start = f"struct(0L AS pos, cast(array() AS array<array<{kind}>>) AS done)"
    fold = f"aggregate({chunks}, {start}, (acc, chunk) -> {step}, q -> struct(q.pos AS pos, flatten(q.done) AS done))"
    return _let("r", fold, done)


def _spans(kind: str) -> Column:
    """array of (m, start, c) of a kind; c is the context before a candidate, of up to CONTEXT code points.

    A candidate has 12 code points or more, so the last three and the pieces between hold its context.
    """
    m, p = f"m_{kind}", f"p_{kind}"
    none = "cast(array() AS array<struct<m:string,start:bigint,c:string>>)"
    pairs = _chunked(f"zip_with({m}, slice({p}, 1, size({m})), (x, y) -> struct(length(y) AS gap, length(x) AS size))")
    starts = _folded(pairs, "bigint", "a.pos + x.gap + x.size", "array(a.pos + x.gap)", "r.done")
    context = "''" if kind not in KINDS[4:] else f"right(concat_ws('', get(f.m, k - 3), get(f.p, k - 2), get(f.m, k - 2), get(f.p, k - 1), get(f.m, k - 1), get(f.p, k)), {CONTEXT})"
    texts = _let("f", f"struct({m} AS m, {p} AS p)", f"transform(f.m, (x, k) -> struct(x AS m, {context} AS c))")
    return F.expr(f"CASE WHEN size({m}) = 0 THEN {none} ELSE zip_with({starts}, {texts}, (s, x) -> struct(x.m AS m, s AS start, x.c AS c)) END")


def with_spans(docs: DataFrame) -> DataFrame:
    """row (the columns of docs as one struct), t (the text), base (start, kind, stop) and candidates (the same, votes and features)."""
    out = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    for kind in KINDS:
        out = out.withColumns(_found(kind))
    out = out.withColumns({f"s_{kind}": _spans(kind) for kind in KINDS})
    base = ", ".join(f"transform(filter(s_{k}, x -> {CHECKS[k]}), x -> struct(x.start AS start, {n} AS kind, x.start + length(x.m) AS stop))" for n, k in enumerate(KINDS[:4]))
    votes = ", ".join(f"{e} AS v_{n}" for n, e in LABELERS.items())
    facts = ", ".join(f"int({e}) AS f_{n}" for n, e in FEATURES.items())
    raw = ", ".join(f"transform(s_{k}, x -> struct(x.start AS start, {n} AS kind, x.start + length(x.m) AS stop, x.m AS m, x.c AS c))" for n, k in enumerate(KINDS) if n >= 4)
    out = out.withColumn("base", F.expr(f"array_sort(concat({base}))"))
    # Base spans in chunks with their bounds: a candidate looks only into chunks that it may touch.
    bounds = "struct(element_at(c, 1).start AS low, array_max(transform(c, b -> b.stop)) AS high, c AS items)"
    out = out.withColumn("zones", F.expr(f"CASE WHEN size(base) > 0 THEN transform({_chunked('base')}, c -> {bounds}) END"))
    touched = "exists(zs, z -> z.low < x.stop AND x.start < z.high AND exists(z.items, b -> b.start < x.stop AND x.start < b.stop))"
    apart = _let("zs", "zones", f"filter(concat({raw}), x -> NOT {touched})")
    out = out.withColumn("raw", F.expr(f"CASE WHEN zones IS NULL THEN concat({raw}) ELSE {apart} END"))
    out = out.withColumn("candidates", F.expr(f"transform(raw, x -> struct(x.start AS start, x.kind AS kind, x.stop AS stop, {votes}, {facts}))"))
    return out.select("row", "t", "base", "candidates")


def estimate_reliability(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 100) -> list[float]:
    """Posterior of each vote pattern: expectation-maximisation of a mixture of two classes whose labelers err independently.

    Starts from the majority of votes; each labeler has, per class, a probability for each of its three votes,
    with a prior as heavy as the data that a vote is right rather than wrong. Without it, a corpus with hardly any
    wrong candidates would have its right ones split in two.
    """
    if not patterns:
        return []
    width = len(patterns[0][0])
    posterior = [1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in patterns]
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        mass = sum(p * n for p, (_, n) in zip(posterior, patterns))
        prior = (mass + 1) / (total + 2)
        heavy = max(10.0, total)
        table = [[{v: heavy * (0.4 if v == 0 else 0.5 if v == (1 if c else -1) else 0.1) for v in (-1, 0, 1)} for c in (0, 1)] for _ in range(width)]
        for p, (votes, n) in zip(posterior, patterns):
            for k, v in enumerate(votes):
                table[k][1][v] += p * n
                table[k][0][v] += (1 - p) * n
        shares = [[{v: x / sum(t.values()) for v, x in t.items()} for t in pair] for pair in table]
        fresh = []
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(shares[k][1][v] / shares[k][0][v]) for k, v in enumerate(votes))
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max(abs(a - b) for a, b in zip(fresh, posterior)) < 1e-6:
            return fresh
        posterior = fresh
    return posterior


def train_classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Weights (the last is the constant) of a logistic model from (features, expected positives, number)."""
    if not rows:
        return []
    width = len(rows[0][0])
    weights = [0.0] * (width + 1)
    total = sum(n for _, _, n in rows)
    for _ in range(rounds):
        slope = [ridge * w for w in weights]
        for x, positive, n in rows:
            z = weights[-1] + sum(w for w, f in zip(weights, x) if f)
            error = (n / (1 + math.exp(-max(-30.0, min(30.0, z)))) - positive) / total
            slope[-1] += error
            for k, f in enumerate(x):
                if f:
                    slope[k] += error
        weights = [w - rate * 4 * s for w, s in zip(weights, slope)]
    return weights


def fit(spans: DataFrame) -> list[float]:
    """Classifier weights; what comes to the driver has one row per vote pattern and feature set (at most 3**5 * 2**10)."""
    votes, facts = [f"v_{n}" for n in LABELERS], [f"f_{n}" for n in FEATURES]
    rows = spans.where(F.size("candidates") > 0).select(F.explode("candidates").alias("x")).groupBy(*[F.col(f"x.{c}").alias(c) for c in votes + facts]).count().collect()
    by_votes: dict[tuple[int, ...], float] = {}
    for r in rows:
        key = tuple(r[c] for c in votes)
        by_votes[key] = by_votes.get(key, 0.0) + r["count"]
    patterns = sorted(by_votes.items())
    posterior = dict(zip((v for v, _ in patterns), estimate_reliability(patterns)))
    by_facts: dict[tuple[int, ...], list[float]] = {}
    for r in rows:
        cell = by_facts.setdefault(tuple(r[c] for c in facts), [0.0, 0.0])
        cell[0] += posterior[tuple(r[c] for c in votes)] * r["count"]
        cell[1] += r["count"]
    return train_classifier(sorted((x, p, n) for x, (p, n) in by_facts.items()))


def _all_spans(weights: list[float]) -> Column:
    """base and the accepted candidates, by start, then kind."""
    if not weights:
        return F.array_sort("base")
    terms = " + ".join(f"({w!r} * x.f_{n})" for w, n in zip(weights, FEATURES))
    accepted = f"transform(filter(candidates, x -> {terms} + ({weights[-1]!r}) >= 0), x -> struct(x.start AS start, x.kind AS kind, x.stop AS stop))"
    return F.expr(f"array_sort(concat(base, {accepted}))")


def _listed(column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({column}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.stop)), ',')")


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and n_added of every row."""
    spans = with_spans(docs.select(F.col("doc_id").cast("long"), "text")).select("row.doc_id", "base", "candidates")
    found = written(spans, "pii-spans")
    out = found.withColumn("every", _all_spans(fit(found)))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {n})) AS bigint)").alias(f"n_{k}") for n, k in enumerate(KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("every").alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_added"))


def _redaction() -> Column:
    """The text t with the spans of every in their kind's name; of overlapping ones the first names all.

    cuts: stretches (low, high) that stay, each followed by a kind (-1: none, after the last).
    """
    kind = "struct<low:bigint,high:bigint,kind:int>"
    cuts = _folded(
        _chunked("every"),
        kind,
        "CASE WHEN x.start < a.pos THEN greatest(a.pos, x.stop) ELSE x.stop END",
        f"CASE WHEN x.start < a.pos THEN cast(array() AS array<{kind}>) ELSE array(struct(a.pos AS low, x.start AS high, x.kind AS kind)) END",
        "concat(r.done, array(struct(r.pos AS low, bigint(length(t)) AS high, -1 AS kind)))",
    )
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    low, high = f"(k * {BLOCK}L)", f"((k + 1) * {BLOCK}L)"
    name = f"CASE WHEN c.kind >= 0 AND c.high >= {low} AND c.high < {high} THEN element_at(array({names}), c.kind + 1) ELSE '' END"
    piece = f"substring(b, int(greatest(c.low - {low}, 0L) + 1), int(least(c.high, {high}) - greatest(c.low, {low})))"
    block = f"array_join(transform(filter(cuts, c -> c.low < {high} AND c.high >= {low}), c -> concat({piece}, {name})), '')"
    whole = f"array_join(transform(regexp_extract_all(t, r'(?s).{{1,{BLOCK}}}', 0), (b, k) -> {block}), '')"
    return F.expr(_let("cuts", cuts, whole))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans count as one.

    n_chars, where there is such a column, follows the new text.
    """
    found = with_spans(docs)
    # All rows, as a filter on the candidates would work them out twice.
    weights = fit(written(found.select("candidates"), "pii-candidates"))
    out = found.withColumn("every", _all_spans(weights))
    out = out.withColumn("redacted", F.when(F.size("every") > 0, _redaction()))
    changed = {"text": F.coalesce("redacted", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("redacted").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return out.select(*[changed.get(c, F.col("row." + "`" + c.replace("`", "``") + "`")).alias(c) for c in docs.columns])
