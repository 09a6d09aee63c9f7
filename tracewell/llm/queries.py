"""The registered queries of this subpackage and the SQL that can check them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import bpe, centroids, lempel_ziv, perplexity, pii, positional_index, quality_gam, sharding, simhash, substrings, tandem, token_files, toxicity
from tracewell.llm.common import documents


def tokenizer_path() -> str:
    """The tokenizer file that the contracts name; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(documents(spark, sf_dir))


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(documents(spark, sf_dir))


def op5_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_positions(documents(spark, sf_dir), tokenizer_path())


def op7_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf_dir))


def op9_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(documents(spark, sf_dir), tokenizer_path())


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempel_ziv.without_earlier(documents(spark, sf_dir))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.periodic_runs(documents(spark, sf_dir))


def op13_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size, array_to_string(words[k:k + least(len(words), 10) - 1], ' ') AS phrase
    FROM items, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(k)
    WHERE len(words) > 0
), sizes AS (
    SELECT DISTINCT size FROM windows
), found AS (
    SELECT row_id, k, size, item_id
    FROM (SELECT row_id, k, size, array_to_string(words[k:k + size - 1], ' ') AS phrase
          FROM docs, sizes, unnest(range(1, len(words) - size + 2)) AS t(k))
    JOIN windows USING (size, phrase)
), hit AS (
    SELECT row_id, count(DISTINCT k + j) AS n_hit
    FROM (SELECT DISTINCT row_id, k, size FROM found), unnest(range(0, size)) AS t(j)
    GROUP BY row_id
), matched AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
    FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM found)
    GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (row_id) LEFT JOIN matched USING (row_id)
"""


OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT row_id, doc_id, k, array_to_string(words[k:k + 12], ' ') AS phrase FROM docs, unnest(range(1, len(words) - 11)) AS t(k)
), earlier AS (
    SELECT row_id, k FROM (SELECT row_id, k, doc_id, min(doc_id) OVER (PARTITION BY phrase) AS first_id FROM windows)
    WHERE first_id < coalesce(doc_id, 9223372036854775807)
), gone AS (
    SELECT row_id, list(DISTINCT k + j) AS places FROM earlier, unnest(range(0, 13)) AS t(j) GROUP BY row_id
), kept AS (
    SELECT row_id, string_agg(word, ' ' ORDER BY k) AS rest
    FROM (SELECT row_id, generate_subscripts(words, 1) AS k, unnest(words) AS word FROM docs WHERE row_id IN (SELECT row_id FROM gone)) d
    ANTI JOIN (SELECT row_id, unnest(places) AS k FROM gone) g USING (row_id, k)
    GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN places IS NULL THEN array_to_string(words, ' ') ELSE coalesce(rest, '') END) AS kept_sha256
FROM docs LEFT JOIN gone USING (row_id) LEFT JOIN kept USING (row_id)
"""


#: Every pair of equal words of a text, in stretches at one distance; of equal stretches the one with the least distance counts.
OP12_SQL = r"""
WITH given AS (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
               lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h
    FROM documents
), placed AS (
    SELECT *, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) ELSE len(words) END AS a, 3 + (h // 10) % 8 AS parts FROM given
), docs AS MATERIALIZED (
    SELECT row_id, doc_id, len(words) AS n, list_transform(range(len(words)), lambda i: words[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(words) - a) // parts) END + 1]) AS words FROM placed
), tokens AS MATERIALIZED (
    SELECT row_id, n, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS w FROM docs
), pairs AS (
    SELECT x.row_id, x.i, y.i - x.i AS q FROM tokens x JOIN tokens y ON x.row_id = y.row_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
    SELECT row_id, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY row_id, q ORDER BY i) AS g FROM pairs) GROUP BY row_id, q, g
), runs AS MATERIALIZED (
    SELECT row_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY row_id, start, length
), told AS (
    SELECT row_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed,
           arg_max(struct_pack(s := start, l := length, p := period), (CAST(length AS DOUBLE) / period, -start, -period)) AS best
    FROM runs GROUP BY row_id
), gone AS (
    SELECT DISTINCT row_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT row_id, string_agg(w, ' ' ORDER BY i) AS rest FROM tokens ANTI JOIN gone USING (row_id, i) WHERE row_id IN (SELECT row_id FROM runs) GROUP BY row_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
       CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(CASE WHEN n_runs IS NULL THEN array_to_string(words, ' ') ELSE coalesce(rest, '') END) AS collapsed_sha256
FROM docs LEFT JOIN told USING (row_id) LEFT JOIN kept USING (row_id)
"""


def op13_sql(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    """The rounds one after another, each a step of WITH; for vectors without an equal id and hash."""
    nearest = """assigned_{r} AS MATERIALIZED (
    SELECT row_id, arg_min(c, (distance, c)) AS c, min(distance) AS distance
    FROM (SELECT x.row_id, y.c, list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM vectors x, centroids_{r} y)
    GROUP BY row_id
)"""
    moved = """centroids_{n} AS MATERIALIZED (
    SELECT o.c, coalesce(m.v, o.v) AS v FROM centroids_{r} o LEFT JOIN (
        SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v
        FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(w.v) AS x, generate_subscripts(w.v, 1) AS j FROM vectors w JOIN assigned_{r} a USING (row_id)) GROUP BY c, j)
        GROUP BY c) m USING (c)
)"""
    steps = [x.format(r=r, n=r + 1) for r in range(rounds) for x in (nearest, moved)] + [nearest.format(r=rounds)]
    return f"""
WITH vectors AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), centroids_0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM vectors ORDER BY h LIMIT {k})
), {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM assigned_{rounds} JOIN vectors USING (row_id) JOIN centroids_{rounds} f USING (c)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_gam, op2_simhash_pigeonhole, op3_weak_supervision, op4_perplexity_rules, op5_label_propagation, op6_token_files, op7_toxic_segments, op8_interval_expansion, op9_bpe_speculate, op10_positional_index, op11_relative_lempel_ziv, op12_tandem_runs, op13_sort_means, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op10_positional_index": OP10_SQL, "op11_relative_lempel_ziv": OP11_SQL, "op12_tandem_runs": OP12_SQL, "op13_sort_means": op13_sql()}
