"""The corpus queries, each one operator with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucidframe.llm import centroids, credentials, exact_dedup, fill_middle, html_extract, language_id, line_dedup, minhash, mixing, pieces, sharding, vectors, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.schedule(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = language_id.sample_pages(table(spark, sf_dir, "pages"))
    return language_id.identify(table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"), labelled=labelled)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.mark_lines(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.flag_copies(table(spark, sf_dir, "documents"))


def op6_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc_zip.round_trip(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op11_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.report(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summarise(centroids.cluster(table(spark, sf_dir, "embeddings")), "vec_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_language_id": op2_language_id,
    "op3_minhash": op3_minhash,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_vector_forest": op6_vector_forest,
    "op7_warc_packages": op7_warc_packages,
    "op8_shard_table": op8_shard_table,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_html_text": op10_html_text,
    "op11_credentials": op11_credentials,
    "op12_fill_middle": op12_fill_middle,
    "op13_centroids": op13_centroids,
    "pipeline": pipeline,
}


def clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Every distance in every round, in whole numbers."""
    square = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    floor = "(s - ((s % n) + n) % n) // n"
    parts = [f"""WITH fine AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda e: CAST(floor(256 * e) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
v AS (SELECT row_number() OVER () AS r, vec_id, x FROM fine),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS INT) AS j, x AS c FROM v QUALIFY j < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, x, min({{'d': d, 'j': j}}) AS best FROM (SELECT r, vec_id, x, j, CAST({square} AS BIGINT) AS d FROM v, c{i}) GROUP BY r, vec_id, x)")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT best.j AS j, i, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT o.j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT j, list(CAST({floor} AS BIGINT) ORDER BY i) AS c FROM s{i} GROUP BY j) m ON o.j = m.j)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, best.j AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.j) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON j = best.j"""


ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix|' || doc_id) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM docs GROUP BY source),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * words / weight, source) AS i,
    coalesce(sum(2.0::DOUBLE * words) OVER (ORDER BY 2.0 * words / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER (ORDER BY 2.0 * words / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM src),
level AS (
  SELECT ((SELECT sum(words) FROM src)::DOUBLE * 1.5::DOUBLE - held) / free AS l FROM ordered
  WHERE ((SELECT sum(words) FROM src)::DOUBLE * 1.5::DOUBLE - held) / free <= 2.0 * words / weight ORDER BY i LIMIT 1),
targets AS (SELECT source, words, least(2.0::DOUBLE * words, (SELECT l FROM level) * weight) AS target FROM src),
placed AS (
  SELECT doc_id, size, words, target, r,
    size + coalesce(sum(size) OVER (PARTITION BY r ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e
  FROM docs d JOIN (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM targets) t ON d.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT r, e + c * words AS e, sum(size) OVER (ORDER BY CAST(e + c * words AS DOUBLE) / target, r, e + c * words ROWS UNBOUNDED PRECEDING) AS served
  FROM placed, (VALUES (0), (1)) AS copies(c) WHERE size > 0),
cut AS (SELECT r, max(e) AS last FROM queue WHERE served <= (SELECT sum(words) FROM src)::DOUBLE * 1.5::DOUBLE GROUP BY r)
SELECT doc_id, size, words AS source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (CAST(coalesce(e <= last, false) AS INT) + CAST(coalesce(e + words <= last, false) AS INT)) ELSE 0 END AS BIGINT) AS taken
FROM placed LEFT JOIN cut ON placed.r = cut.r""",
    "op3_minhash": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM docs WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, v FROM reach JOIN links ON b = u),
label AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN label ON a = d.doc_id""",
    "op4_line_dedup": r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS place FROM cut),
filled AS (
  SELECT doc_id, place, t, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w, length(regexp_replace(x, '[ \t\n\v\f\r]+', '', 'g')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS i
  FROM (SELECT doc_id, place, x, regexp_replace(x, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS t FROM line) WHERE t <> ''),
win AS (
  SELECT doc_id, i, t AS a, lead(t) OVER d AS b, lead(t, 2) OVER d AS c, w > 50 OR n > 300 AS long1, w + lead(w) OVER d > 50 OR n + lead(n) OVER d > 300 AS long2
  FROM filled WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
runs AS (
  SELECT 3 AS run, doc_id, i, a, b, c FROM win WHERE c IS NOT NULL
  UNION ALL SELECT 2, doc_id, i, a, b, NULL FROM win WHERE b IS NOT NULL AND long2
  UNION ALL SELECT 1, doc_id, i, a, NULL, NULL FROM win WHERE long1),
later AS (
  SELECT doc_id, CASE WHEN doc_id = fd THEN greatest(i, fi + run) ELSE i END AS lo, i + run AS hi
  FROM (SELECT run, doc_id, i, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi FROM runs WINDOW w AS (PARTITION BY run, a, b, c ORDER BY doc_id, i))
  WHERE NOT (doc_id = fd AND i = fi)),
gone AS (SELECT DISTINCT f.doc_id, f.place FROM filled f JOIN later l ON f.doc_id = l.doc_id AND f.i >= l.lo AND f.i < l.hi),
kept AS (
  SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.place) AS rest FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place
  WHERE g.place IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM filled GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT cut.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(rest, '')) AS clean_sha256, CAST(length(coalesce(rest, '')) AS BIGINT) AS clean_chars
FROM cut LEFT JOIN kept ON cut.doc_id = kept.doc_id LEFT JOIN n ON cut.doc_id = n.doc_id LEFT JOIN r ON cut.doc_id = r.doc_id""",
    "op6_vector_forest": """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9::DOUBLE),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT a, v FROM reach JOIN links ON b = u),
label AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN label ON a = vec_id LEFT JOIN degree ON u = vec_id""",
    "op7_warc_packages": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
    array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
      lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> b) & 31 AS INT) + 1, 1)), '')), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY payload) AS keep
  FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM d""",
    "op12_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM p),
x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x""",
    "op13_centroids": clustering_sql(),
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
