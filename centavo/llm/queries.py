"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from centavo.llm import decontaminate, hilbert, html_text, jaccard, middle, neighbours, personal, pieces, product_codes, repeats, secrets, token_counts, toxicity
from centavo.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


OP6_SQL = r"""
WITH d AS (
SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pieces AS (
SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS piece
FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), spots AS (
SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS piece
FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM pieces))
), found AS (
SELECT doc_id, item, i, spots.n FROM spots JOIN pieces USING (n, piece)
), hit AS (
SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), items AS (
SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, table(spark, sf_dir, "benchmark")))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = r"""
WITH RECURSIVE d AS (
SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
FROM documents
), s AS (
SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id
), shared AS (
SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_both >= 75 * (a.size + b.size - n_both)
), reach AS (
SELECT doc_id AS x, doc_id AS y FROM d
UNION
SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), least AS (
SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""


@query("op8_ngram_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op7_hilbert_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = hilbert.document_cells(table(spark, sf_dir, "documents"))
    placed = hilbert.shard(cells, ["d_source", "d_lang", "d_size", "d_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op1_sentence_pieces")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_and_checked(table(spark, sf_dir, "documents"))


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.personal_spans(table(spark, sf_dir, "documents")))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH d AS (
SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents
), k AS (
SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
       CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
            WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), s AS (
SELECT doc_id, t, n, form, array_to_string(u[1 : least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1 : greatest(x, y)], '') AS m,
       array_to_string(u[greatest(x, y) + 1 : n], '') AS s FROM k
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM s
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.fill_in_middle(table(spark, sf_dir, "documents")))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_sql(rounds: int = 2) -> str:
    """Every part against every entry of its codebook, in each round and once more."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
SELECT vec_id, q.p, any_value(q.v) AS v, min(dist * 64 + e) % 64 AS e, min(dist) AS dist
FROM (SELECT q.vec_id, q.p, q.v, b.e, list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM q JOIN b{r} b ON b.p = q.p) q GROUP BY vec_id, q.p
)""")
        if r < rounds:
            steps.append(f"""m{r} AS (
SELECT p, e, list(x ORDER BY j) AS v FROM (
SELECT p, e, j, CAST(floor(CAST(sum(v[j]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT p, e, v, unnest(range(1, len(v) + 1)) AS j FROM a{r}) GROUP BY p, e, j) GROUP BY p, e
), b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH k AS (
SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS MATERIALIZED (
SELECT vec_id, p, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS v FROM (SELECT vec_id, x, unnest(range(16)) AS p FROM k)
), b0 AS MATERIALIZED (
SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM q) WHERE e < 64
), {", ".join(steps)}, told AS (
SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
FROM (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM b{rounds})
), coded AS (
SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN k USING (vec_id), told
"""


@query("op13_product_codes", op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.digest(table(spark, sf_dir, "embeddings"))
