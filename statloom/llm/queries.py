"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _fold() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, held_out=F.coalesce(_fold() == 1, F.lit(False)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archives

    index = write_archives(_table(spark, sf_dir, "pages"))
    return read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    vectors = quantised(_table(spark, sf_dir, "embeddings"))
    found = top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .languageid import identify, profiles

    docs = _table(spark, sf_dir, "documents")
    known = profiles(docs, train=_fold() != 0)
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, F.lit(False))
    return identify(docs, known).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pathjoin import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    return cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minmax import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_lm_scoring, op3_quality, op4_warc, op5_decontamination, op6_html, op7_secrets, op8_topk, op9_language_id, op10_ngram_join, op11_clustering, op12_minhash, op13_resampling)}

#: The revisit rule in SQL: digests and sizes of payloads, and the smallest id of each shared payload.
_WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS e, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, e FROM v) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def _clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds one after the other: nearest centroids by full distances, then whole means."""
    near = """SELECT v.id, v.vec_id, v.e, arg_min(c.cluster, (d.x, c.cluster)) AS cluster, min(d.x) AS distance
      FROM v CROSS JOIN {c} c CROSS JOIN LATERAL (SELECT CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS x) d GROUP BY 1, 2, 3"""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster, e FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(c=f'c{r}')})",
            f"m{r} AS (SELECT cluster, j, sum(e[j]) AS s, count(*) AS n FROM a{r} CROSS JOIN range(1, {dims + 1}) t(j) GROUP BY 1, 2)",
            f"n{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY j) AS e FROM (SELECT cluster, j, CAST(s AS HUGEINT) AS s, n FROM m{r}) GROUP BY 1)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN n{r} n USING (cluster))",
        ]
    parts += [f"a AS MATERIALIZED ({near.format(c=f'c{rounds}')})", f"h AS (SELECT cluster, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM c{rounds})"]
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
      CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a JOIN h USING (cluster)"""


#: All pairs that share a shingle, without signatures; pairs of one component are reached step by step.
_MINHASH_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
n AS MATERIALIZED (SELECT doc_id, len(x) AS n, list_sort(x) AS x FROM s),
e AS MATERIALIZED (SELECT x, n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY 1, 2),
t AS MATERIALIZED (SELECT rep, n, md5_number(unnest(x)) AS h FROM e),
f AS (SELECT h, count(*) AS often FROM t GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY often, h) AS place FROM t JOIN f USING (h)),
p AS MATERIALIZED (SELECT rep, n, h FROM k WHERE place <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1 AND often > 1),
c AS MATERIALIZED (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN e x ON x.rep = c.a JOIN e y ON y.rep = c.b WHERE 180 * len(list_intersect(x.x, y.x)) >= 80 * (x.n + y.n)),
g AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS a, rep AS b FROM e UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.low, n.doc_id) AS component_id, n.doc_id = coalesce(m.low, n.doc_id) AS kept
FROM n LEFT JOIN e ON n.x = e.x AND n.n > 0 LEFT JOIN m ON m.a = e.rep
"""

#: CRC-32 bit by bit over each distinct word's bytes.
_RESAMPLING_SQL = r"""
WITH d AS MATERIALIZED (SELECT 'd' AS kind, doc_id, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', NULL, -row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
u AS MATERIALIZED (SELECT kind, id, unnest(w) AS w FROM d),
x AS (SELECT w, hex(encode(w)) AS y FROM (SELECT DISTINCT w FROM u)),
z AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(y), 2), lambda i: CAST((instr('0123456789ABCDEF', y[i]) - 1) * 16 + instr('0123456789ABCDEF', y[i + 1]) - 1 AS BIGINT))),
  lambda acc, byte: STEP), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM x),
v AS MATERIALIZED (SELECT kind, id, bucket FROM u JOIN z USING (w)),
n AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM v GROUP BY 1),
a AS (SELECT coalesce(sum(s), 0) AS ss, coalesce(sum(t), 0) AS tt FROM n),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (ss + 10000) / (CAST(s + 1 AS DOUBLE) * (tt + 10000)))) AS BIGINT) AS gain FROM n CROSS JOIN a),
f AS (SELECT id, count(*) AS k, CAST(sum(gain) AS BIGINT) AS total FROM v JOIN g USING (bucket) WHERE kind = 'd' GROUP BY 1),
w AS (SELECT doc_id, len(d.w) AS n_features, CAST(coalesce((total - ((total % k) + k) % k) / k, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN f USING (id) WHERE kind = 'd'),
o AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM w),
q AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM o WHERE n_features >= 20 AND doc_id IS NOT NULL),
y AS (SELECT 10 * count(*) // 100 AS take FROM q)
SELECT doc_id, n_features, weight, score, CAST(NULL AS BIGINT) AS rank FROM o WHERE n_features < 20 OR doc_id IS NULL
UNION ALL SELECT doc_id, n_features, weight, score, CASE WHEN place <= take THEN place END FROM q CROSS JOIN y
"""


def _crc_step(value: str, bits: int = 8) -> str:
    """A byte's eight steps of the register, as nested expressions through one-element lists."""
    for _ in range(bits):
        value = f"list_transform([{value}], lambda q: CASE WHEN q % 2 = 1 THEN xor(q >> 1, CAST(3988292384 AS BIGINT)) ELSE q >> 1 END)[1]"
    return value


ORACLE_SQL = {"op4_warc": _WARC_SQL, "op8_topk": _TOPK_SQL, "op11_clustering": _clustering_sql(), "op12_minhash": _MINHASH_SQL, "op13_resampling": _RESAMPLING_SQL.replace("STEP", _crc_step("xor(acc, byte)"))}
