"""The registered queries ``opN_<name>`` over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, mixing, near_dedup, packing, quality, token_count, toxicity, vector_search, warc
from .common import P


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("copies")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", F.col(P + "n_lines").alias("n_lines"), F.col(P + "n_dropped").alias("n_dropped"), F.sha2(P + "kept", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


_ALL = (
    op1_pack_documents, op2_mix_sources, op3_exact_dedup, op4_near_dedup, op5_line_dedup,
    op6_toxicity, op7_warc_round_trip, op8_vector_search, op9_quality, op10_token_counts,
)
QUERIES = {f.__name__: f for f in _ALL}

SQL = {
    "op2_mix_sources": """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, CAST(sum(size) OVER () - 3 * coalesce(sum(size) OVER o, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY CAST(size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, CAST(size AS DOUBLE) / weight) AS level FROM l WHERE weight * level <= 3 * size),
t AS (SELECT source, size AS source_size, least(weight * coalesce((SELECT level FROM m), CAST('inf' AS DOUBLE)), CAST(3 * size AS DOUBLE)) AS target FROM w),
u AS (SELECT *, CAST(least(floor(target / greatest(source_size, 1)), 3) AS BIGINT) AS turns FROM t),
r AS (SELECT d.*, u.source_size, u.target, u.turns, u.target - u.turns * u.source_size AS rest FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
g AS (SELECT source, h, rest, sum(size) AS size FROM r GROUP BY source, h, rest),
c AS (SELECT source, h, rest, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, size FROM g),
k AS (SELECT source, h, below + size <= rest OR (below < rest AND below + size - rest < rest - below) AS more FROM c)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST((r.turns + CASE WHEN r.rest > 0 AND k.more THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source AND r.h = k.h""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op4_near_dedup": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n""",
    "op5_line_dedup": """
WITH l AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
k AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT l.doc_id, line, pos, coalesce(k.owner < l.doc_id, false) AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_warc_round_trip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM p),
a AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS alphabet)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr(alphabet, (x >> 15) % 32 + 1, 1) || substr(alphabet, (x >> 10) % 32 + 1, 1) || substr(alphabet, (x >> 5) % 32 + 1, 1) || substr(alphabet, x % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY hex) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER (PARTITION BY hex) THEN min(page_id) OVER (PARTITION BY hex) END AS refers_to
FROM b, a""",
    "op8_vector_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
