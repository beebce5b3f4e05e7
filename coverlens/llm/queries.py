"""The registered queries of the operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.llm import (
    centroids,
    decontaminate,
    licenses,
    lm,
    overlaps,
    packing,
    pii,
    prefixes,
    simhash,
    topk,
    toxicity,
    warc,
    wordpieces,
)
from coverlens.llm.common import new_path

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(_table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files <source>/<lang>/<doc_id>.txt."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    doc_id = F.regexp_extract("path", r"(-?[0-9]+)\.txt$", 1).cast("long").alias("doc_id")
    return found.select(doc_id, "path", "license", "score", "via", "from_path")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), new_path(spark, "archives"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps.join(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def _centroid_rounds(rounds: int) -> str:
    """The rounds of `op12_centroids`, each as three steps of a DuckDB statement."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
        apart{n} AS (
            SELECT kept.row, kept.vec_id, kept.v, middle.cluster,
                   list_sum(list_transform(list_zip(kept.v, middle.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
            FROM kept CROSS JOIN middle{n} AS middle
        ), near{n} AS (
            SELECT * FROM apart{n} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1
        )""")
        if n < rounds:
            steps.append(f"""
        sums{n} AS (
            SELECT cluster, pos, count(*) AS n, sum(x) AS total
            FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM near{n}) GROUP BY cluster, pos
        ), mean{n} AS (
            SELECT cluster, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v
            FROM sums{n} GROUP BY cluster
        ), middle{n + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(mean{n}.v, middle{n}.v) AS v FROM middle{n} LEFT JOIN mean{n} USING (cluster)
        )""")
    return ",".join(steps)


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_topk": op3_topk,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_language_model": op10_language_model,
    "op11_ngram_join": op11_ngram_join,
    "op12_centroids": op12_centroids,
    "op13_prefixes": op13_prefixes,
}

ORACLES: dict[str, str] = {
    "op3_topk": """
        WITH scaled AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM scaled q JOIN scaled c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op9_warc": """
        WITH rows AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), newest AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM rows
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
        FROM newest
    """,
    "op12_centroids": f"""
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) = 64
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), middle0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), v) - 1 AS INTEGER) AS cluster, v
            FROM kept QUALIFY cluster < 40
        ), {_centroid_rounds(5)}
        SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance,
               CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(middle5.v, ',')) AS centroid_sha256
        FROM near5 JOIN middle5 USING (cluster)
    """,
    # CRC-32 bit by bit: the remainder is a byte's, shifted out over the reversed polynomial
    "op13_prefixes": """
        WITH turns AS (
            SELECT conv_id, coalesce(text, '') AS text, sha256(concat(strlen(coalesce(role, '')), ':', role, text)) AS key,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ), about AS (
            SELECT conv_id, list({'key': key, 'bytes': strlen(text)} ORDER BY pos) AS own,
                   xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
                       string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
                           lambda r, step: xor(r >> 1, 3988292384 * (r & 1))))) % 9 AS h
            FROM turns GROUP BY conv_id
        ), rebuilt AS (
            SELECT a.conv_id, coalesce(b.own[:a.h], []) || a.own[a.h + 1:] AS path
            FROM about a LEFT JOIN about b ON b.conv_id = a.conv_id - a.conv_id % 5
        ), members AS (
            SELECT conv_id, depth, len(path) = depth AS ends,
                   array_to_string(list_transform(path[:depth], lambda t: t['key']), '') AS id,
                   coalesce(path[depth]['bytes'], 0) AS bytes
            FROM (SELECT *, unnest(range(len(path) + 1)) AS depth FROM rebuilt)
        ), nodes AS MATERIALIZED (
            SELECT id, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
                   sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM members GROUP BY id, depth
        ), related AS (
            SELECT u.id, count(*) FILTER (v.depth = u.depth + 1) AS n_children, sum(v.saved) AS saved_tokens,
                   count(*) FILTER (NOT EXISTS (SELECT 1 FROM nodes w WHERE w.depth = v.depth + 1 AND left(w.id, -64) = v.id)) AS n_leaves
            FROM nodes u JOIN nodes v ON starts_with(v.id, u.id) GROUP BY u.id
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, r.n_children, r.n_leaves,
               CAST(r.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n JOIN related r USING (id) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.id = left(n.id, -64)
    """,
}
