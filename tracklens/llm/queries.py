"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.embed_dedup import embedding_near_dedup
from tracklens.llm.exact_dedup import exact_dedup
from tracklens.llm.html_extract import extract_main_text
from tracklens.llm.id_files import token_id_rows
from tracklens.llm.language_id import held_out, predict_languages
from tracklens.llm.mixing import mix_plan
from tracklens.llm.near_dedup import near_dedup
from tracklens.llm.packing import pack_documents
from tracklens.llm.phrases import collocations
from tracklens.llm.secret_scan import scan_secrets
from tracklens.llm.sharding import extendible_shards
from tracklens.llm.spelling import spelling_variants
from tracklens.llm.token_counts import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), width=2)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predict_languages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op6_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extendible_shards(_table(spark, sf_dir, "documents"))
    name = F.when(F.col("page") > 0, F.concat_ws("-", "shard", "page")).otherwise(F.col("shard"))
    return found.select("doc_id", "n_bytes", name.alias("shard"), "depth", "shard_bytes")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_no", "run_no", "n_chars", "core_sha256", "score", "is_secret")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")


def op11_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_rows(_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_extendible_sharding": op6_extendible_sharding,
    "op7_secret_scan": op7_secret_scan,
    "op8_packing": op8_packing,
    "op9_source_mixing": op9_source_mixing,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_id_files": op11_token_id_files,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL = {
    "op12_phrase_collocations": r"""
        WITH d AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
          FROM documents),
        p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
        g AS (
          SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, range(1, 4) s(k) WHERE len(w) >= k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
        t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 10),
        q AS MATERIALIZED (
          SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail
          FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
        u AS (
          SELECT q.lang, q.phrase, q.a, cut, x.n AS l, y.n AS r,
                 CAST(CAST(1000000 AS HUGEINT) * q.a * q.a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
          FROM q JOIN f x ON x.lang = q.lang AND x.phrase = q.head JOIN f y ON y.lang = q.lang AND y.phrase = q.tail),
        b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM u),
        o AS (
          SELECT lang, phrase, max(a) AS around
          FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY lang, phrase),
        z AS (
          SELECT b.lang, b.phrase, b.a, b.l, b.r, b.score,
                 row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, encode(b.phrase)) AS rank
          FROM b LEFT JOIN o USING (lang, phrase) WHERE pick = 1 AND (around IS NULL OR 100 * around < 50 * b.a))
        SELECT z.lang, rank, phrase, a, l, r, t.n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
    """,
    "op6_extendible_sharding": r"""
        WITH d AS (
          SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                 right(repeat('0', 60) || bin(CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 15) AS BIGINT)), 60) AS bits
          FROM documents),
        p AS (SELECT doc_id, n_bytes, depth, left(bits, depth) AS prefix FROM d, range(0, 61) r(depth)),
        s AS (SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n FROM p GROUP BY depth, prefix),
        f AS (
          SELECT p.doc_id, p.n_bytes, p.prefix AS shard, CAST(p.depth AS INTEGER) AS depth, s.shard_bytes,
                 row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
          FROM p JOIN s USING (depth, prefix) WHERE s.shard_bytes <= 4194304 OR s.n = 1)
        SELECT doc_id, n_bytes, shard, depth, shard_bytes FROM f WHERE k = 1
    """,
    "op2_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        edges AS (
          SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
          WHERE list_cosine_similarity(p.e, q.e) >= 0.95),
        reach AS (
          SELECT vec_id AS node, vec_id AS root FROM embeddings
          UNION
          SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node),
        c AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
        n AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
        SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.root AS component_id, e.vec_id = c.root AS kept
        FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
    """,
    "op1_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS words
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
          FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 1))) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (
          SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
          FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (
          SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
          WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
          SELECT doc_id AS node, doc_id AS root FROM documents
          UNION
          SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
        FROM documents d LEFT JOIN n USING (doc_id)
        JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) c ON c.node = d.doc_id
    """,
    "op9_source_mixing": r"""
        WITH d AS (
          SELECT doc_id, source,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 md5('mix-17-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
          FROM documents),
        s AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS n,
                 row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS idx
          FROM d GROUP BY source),
        w AS (SELECT *, CASE idx % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
        o AS (
          SELECT *, row_number() OVER (ORDER BY 2 * n / CAST(weight AS DOUBLE), idx) AS k,
                 (SELECT CAST(sum(n) AS BIGINT) * 150 / CAST(100 AS DOUBLE) FROM s) AS total
          FROM w),
        c AS (
          SELECT *, CAST(coalesce(sum(2 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS closed,
                 CAST(sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS open_weight
          FROM o),
        first_open AS (
          SELECT k, (total - closed) / open_weight AS level FROM c
          WHERE (total - closed) / open_weight * weight <= 2 * n ORDER BY k LIMIT 1),
        t AS (
          SELECT c.source, c.n AS source_size,
                 CASE WHEN f.k IS NOT NULL AND c.k >= f.k THEN f.level * weight ELSE CAST(2 * c.n AS DOUBLE) END AS target
          FROM c LEFT JOIN first_open f ON true),
        q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
        r AS (
          SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
          FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0
                    ELSE quota // source_size * size + greatest(0, least(size, quota % source_size - start)) END AS BIGINT) AS taken
        FROM r
    """,
    "op3_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
          FROM documents),
        w AS (
          SELECT content, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size
          FROM d GROUP BY content)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
        FROM d JOIN w USING (content)
    """,
}
