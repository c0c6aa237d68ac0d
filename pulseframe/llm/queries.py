"""The operators' queries over the whole tables of a folder, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import bpe, exact_dedup, hard_negatives, langid, lm_scoring, media, mixing, ngram_join, prefix_trie, simhash, substring_dedup, toxicity, url_filters
from pulseframe.llm.common import remainder, written

#: Fixed rules of op8: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 4) == 2
    found = langid.identify(docs, langid.train(docs, ~held_out))
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.strip_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(written(media.encode(documents(spark, sf_dir)), "media"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(documents(spark, sf_dir))


QUERIES = {"op1_language_id": op1_language_id, "op2_lm_scoring": op2_lm_scoring, "op3_exact_dedup": op3_exact_dedup, "op4_bpe": op4_bpe, "op5_simhash": op5_simhash, "op6_substring_dedup": op6_substring_dedup, "op7_toxicity": op7_toxicity, "op8_url_filters": op8_url_filters, "op9_media": op9_media, "op10_mixing": op10_mixing, "op11_prefix_trie": op11_prefix_trie, "op12_hard_negatives": op12_hard_negatives, "op13_ngram_join": op13_ngram_join}

OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY digest ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = max(n) OVER (PARTITION BY digest) AS kept, digest AS text_sha256 FROM best
"""

OP8_SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), fits AS (
  SELECT k, rh || rp AS rule, rv, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (k)
"""

OP10_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source
), s1 AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (3 * source_size)::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE AS total FROM s0
), s2 AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM s1
), s3 AS (
  SELECT *, (SELECT lv FROM s2 WHERE lv * weight <= most ORDER BY most / weight, sid LIMIT 1) AS level FROM s2
), s4 AS (
  SELECT source, sid, source_size, least(most, level * weight) AS target FROM s3
), s AS (
  SELECT *, least(round(target)::BIGINT, 3 * source_size) AS words FROM s4
), blocked AS (
  SELECT *, greatest(1, least(1024, words // 1024)) AS block FROM s
), lined AS (
  SELECT *, (words + block - 1) // block AS blocks, (sum((words + block - 1) // block) OVER (ORDER BY sid) - (words + block - 1) // block)::BIGINT AS low, sum((words + block - 1) // block) OVER ()::BIGINT AS points FROM blocked
), points AS (
  SELECT sid, length(bin(points - 1)) AS bits, unnest(generate_series(low, low + blocks - 1)) AS point FROM lined WHERE blocks > 0
), slots AS (
  SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank
  FROM (SELECT sid, list_sum(list_transform(range(bits), lambda i: ((point >> i) & 1) << (bits - 1 - i)))::BIGINT AS slot FROM points)
), placed AS (
  SELECT row_number() OVER () AS k, doc_id, size, source_size, target, words, sid, block,
    (sum(size) OVER (PARTITION BY sid ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
  FROM sized JOIN lined ON sized.source IS NOT DISTINCT FROM lined.source
), turns AS (
  SELECT k, sid, block, size, words, start + unnest(range(3)) * source_size AS a FROM placed
), parts AS (
  SELECT k, sid, block, a, least(a + size, words) AS b, unnest(generate_series(a // block, (least(a + size, words) - 1) // block)) AS rank FROM turns WHERE size > 0 AND a < words
), got AS (
  SELECT k, sum(least(b, (rank + 1) * block) - greatest(a, rank * block))::BIGINT AS taken, min(slot) AS first_slot, max(slot) AS last_slot FROM parts JOIN slots USING (sid, rank) GROUP BY k
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, start, first_slot, last_slot FROM placed LEFT JOIN got USING (k)
"""

OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), heads AS (
  SELECT *, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h FROM turns
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS s FROM heads a LEFT JOIN turns b ON a.base = b.conv_id
), prefixes AS (
  SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM prefixes GROUP BY p, d
), family AS (
  SELECT a.conv_id, a.depth, a.n_convs, a.ends_sha256, b.conv_id AS parent_conv_id, a.p,
    (SELECT count(*) FROM nodes c WHERE c.depth = a.depth + 1 AND c.p[1:a.depth] = a.p) AS n_children FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth - 1 AND b.p = a.p[1:a.depth - 1]
), below AS (
  SELECT p[1:up] AS p, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[depth].x, '[^\x20\x09-\x0D]+')) END)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM family) GROUP BY 1, 2
)
SELECT conv_id, f.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM family f JOIN below USING (p, depth)
"""

OP12_SQL = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a, v b WHERE a.id % 100 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""

OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT k, doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(list_zip(ws[:-3], ws[2:-2], ws[3:]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3]) END) AS sh FROM w
), t AS (
  SELECT k, len(sh) AS n, unnest(sh) AS x FROM s
), p AS (
  SELECT a.k AS a, b.k AS b FROM t a JOIN t b USING (x) GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(min(o.doc_id), s.doc_id) AS component_id FROM s LEFT JOIN r ON s.k = r.a LEFT JOIN s o ON o.k = r.b GROUP BY s.k, s.doc_id, len(s.sh)
"""

ORACLES = {"op3_exact_dedup": OP3_SQL, "op8_url_filters": OP8_SQL, "op10_mixing": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_ngram_join": OP13_SQL}
