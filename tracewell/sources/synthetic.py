"""A seeded source of synthetic requests, and the TCP events of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight, client and server namespace, method, path, port, base latency in microseconds, chance of an error.
PATTERNS = [
    (40, 1001, 1002, "GET", "/api/users", 8001, 20_000, 0.01), (30, 1001, 1002, "GET", "/api/users/123", 8001, 15_000, 0.01), (25, 1001, 1003, "POST", "/api/orders", 8002, 50_000, 0.02),
    (20, 1001, 1003, "GET", "/api/orders/456", 8002, 25_000, 0.01), (20, 1003, 1004, "POST", "/api/payments", 8003, 80_000, 0.03), (20, 1002, 1004, "GET", "/db/query", 8004, 5_000, 0.005), (20, 1003, 1004, "GET", "/db/query", 8004, 8_000, 0.005),
]


def requests(spark: SparkSession, n: int, **more) -> DataFrame:
    """n requests, as requests_of makes them."""
    return requests_of(spark.range(n), **more)


def requests_of(ids: DataFrame, seed: int = 42, spike_chance: float = 0.02, spike_factor: float = 10.0, start_ns: int = 1_700_000_000_000_000_000, gap_ns: int = 20_000_000, patterns: list[tuple] = PATTERNS) -> DataFrame:
    """A request for every id: a pattern by weight, ports in turn, 30 % jitter, rare spikes and errors; equal seeds give equal rows."""
    total = sum(p[0] for p in patterns)
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), F.lit(1_000_003)) / 1_000_003.0
    draw, pick, at = u(1) * total, F.lit(len(patterns) - 1), 0
    for k, p in reversed(list(enumerate(patterns[:-1]))):
        at = sum(q[0] for q in patterns[: k + 1])
        pick = F.when(draw < at, k).otherwise(pick)
    field = lambda k: F.element_at(F.array(*[F.lit(p[k]) for p in patterns]), F.col("pattern") + 1)
    out = ids.withColumn("pattern", pick)
    spike = F.when(u(2) < spike_chance, spike_factor).otherwise(1.0)
    return out.select(
        F.col("id").alias("request_id"), field(1).cast("bigint").alias("client"), field(2).cast("bigint").alias("server"), field(3).alias("method"), field(4).alias("path"), field(5).alias("dst_port"),
        (F.lit(40000) + F.col("id") % 20001).cast("int").alias("src_port"), (F.lit(start_ns) + F.col("id") * gap_ns).alias("start_ns"),
        F.floor(field(6) * (0.7 + 0.6 * u(3)) * spike).cast("bigint").alias("latency_us"), F.when(u(4) < field(7), 500).otherwise(200).alias("status"),
    )


#: Name and address of each demo namespace, and the reason of each status.
SERVICES = {1001: ("api-gateway", "172.17.0.2"), 1002: ("user-service", "172.17.0.3"), 1003: ("payment-service", "172.17.0.4"), 1004: ("db-service", "172.17.0.5")}
REASONS = {200: "OK", 201: "Created", 500: "Internal Server Error"}


def _known(values: dict, key: str, other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def expanded(requests: DataFrame) -> DataFrame:
    """Seven TCP events of each request: connect, accept, the request out and in, the response out and in, close."""
    of = lambda field, key: _known({k: v[field] for k, v in SERVICES.items()}, key, "")
    ask = F.concat("method", F.lit(" "), "path", F.lit(" HTTP/1.1\r\nHost: "), of(0, "server"), F.lit(":"), F.col("dst_port").cast("string"), F.lit("\r\n\r\n"))
    answer = F.concat(F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" "), _known(REASONS, "status", "Unknown"), F.lit("\r\nContent-Length: 0\r\n\r\n"))
    end, none = F.col("latency_us"), F.lit("")
    steps = [("connect", "client", F.lit(0), none), ("accept", "server", F.lit(100), none), ("send", "client", F.lit(200), ask), ("recv", "server", F.lit(300), ask), ("send", "server", end - 200, answer), ("recv", "client", end - 100, answer), ("close", "client", end, none)]
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(kind).alias("kind"), F.col(side).cast("bigint").alias("netns"), at.cast("bigint").alias("at"), payload.alias("payload")) for k, (kind, side, at, payload) in enumerate(steps)])
    x = requests.select("request_id", "start_ns", of(1, "client").alias("src_ip"), "src_port", of(1, "server").alias("dst_ip"), "dst_port", F.explode(rows).alias("e"))
    return x.select((F.col("request_id") * len(steps) + F.col("e.k")).alias("seq"), (F.col("start_ns") + F.col("e.at") * 1000).alias("timestamp_ns"), "e.netns", "e.kind", "src_ip", "src_port", "dst_ip", "dst_port", F.encode("e.payload", "UTF-8").alias("payload"))
