"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, ctw, decontaminate, langid, mainhtml, neardup, quality, sstable, tokencounts, toxicity, trie, warc
from .common import fold, table


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), fold("doc_id", 3) != 1)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ctw.scores(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return found.withColumn("held_out", ~F.col("train")).drop("train")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.counted(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op10_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


_ALL = (
    op1_toxicity, op2_decontamination, op3_quality_rules, op4_bpe, op5_language_id,
    op6_near_duplicates, op7_context_tree_weighting, op8_token_counts, op9_main_text, op10_sorted_string_tables,
    op11_prefix_trie, op12_centroid_clustering, op13_warc,
)
QUERIES = {f.__name__: f for f in _ALL}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: One round of clustering: nearest centroids, then the floors of their means.
_ASSIGN = """a{i} AS MATERIALIZED (SELECT rid, vec_id, v, min(struct_pack(d := d, c := c)).c c, min(struct_pack(d := d, c := c)).d d FROM (
  SELECT x.rowid rid, x.vec_id, x.v, k.c, list_sum(list_transform(list_zip(x.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) d FROM (SELECT row_number() OVER () rowid, * FROM x) x, c{i} k) GROUP BY ALL)"""
_ROUND = _ASSIGN + """, m{i} AS (SELECT c, p, sum(t) s, count(*) n FROM (SELECT c, generate_subscripts(v, 1) p, unnest(v) t FROM a{i}) GROUP BY ALL),
l{i} AS (SELECT c, list(CAST((s - ((s %% n) + n) %% n) // n AS HUGEINT) ORDER BY p) v FROM m{i} GROUP BY c), c%s AS MATERIALIZED (SELECT k.c, coalesce(l.v, k.v) v FROM c{i} k LEFT JOIN l{i} l ON l.c = k.c)"""

ORACLE = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), b AS (SELECT item_id, {_WORDS} w FROM benchmark),
bi AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(w[i:i + 9], ' ') s FROM bi),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) i, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) s FROM d, ks WHERE len(w) >= k),
occ AS (SELECT DISTINCT doc_id, i, k, item_id FROM dp JOIN win USING (k, s)),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END sh FROM d),
e AS (SELECT doc_id, len(sh) n, unnest(sh) h FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, any_value(a.n) + any_value(b.n) n, count(*) shared FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (n - shared)), ed AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id u, doc_id v FROM d UNION SELECT r.u, ed.b FROM r JOIN ed ON ed.a = r.v),
c AS (SELECT u, min(v) component_id FROM r GROUP BY u)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) n_shingles, component_id, s.doc_id = component_id kept FROM s JOIN c ON u = s.doc_id""",
    "op11_prefix_trie": """
WITH t AS MATERIALIZED (SELECT conv_id c, coalesce(text, '') x, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) k,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) i FROM conversations WHERE conv_id IS NOT NULL),
ids AS MATERIALIZED (SELECT c, xor(4294967295, list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT)),
  lambda a, b: list_reduce([CAST(0 AS BIGINT) for z in range(8)], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, xor(a, b)), CAST(4294967295 AS BIGINT))) % 6 h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT ids.c, 0 part, i, k, x FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND i <= h UNION ALL SELECT ids.c, 1, i, k, x FROM ids JOIN t ON t.c = ids.c AND i > h),
m AS MATERIALIZED (SELECT c, row_number() OVER w d, array_to_string(list(k) OVER w, '') k, length(x) chars FROM r WINDOW w AS (PARTITION BY c ORDER BY part, i) UNION ALL SELECT c, 0, '', 0 FROM ids),
n AS MATERIALIZED (SELECT k, min(c) conv_id, any_value(d) AS depth, count(*) n_convs, any_value(chars) chars, CASE WHEN k <> '' THEN left(k, length(k) - 32) END up FROM m GROUP BY k),
kids AS (SELECT up k, count(*) n_children FROM n WHERE up IS NOT NULL GROUP BY up),
below AS (SELECT left(n.k, 32 * j) k, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) n_leaves, sum((n_convs - 1) * chars) saved FROM (SELECT *, unnest(range(0, depth + 1)) j FROM n) n LEFT JOIN kids ON kids.k = n.k GROUP BY 1),
ends AS (SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) s FROM (SELECT * FROM m QUALIFY d = max(d) OVER (PARTITION BY c)) GROUP BY k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(s, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.k = n.up LEFT JOIN kids ON kids.k = n.k JOIN below ON below.k = n.k LEFT JOIN ends ON ends.k = n.k""",
    "op12_centroid_clustering": f"""
WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS HUGEINT)) v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 c, v FROM x WHERE vec_id IS NOT NULL QUALIFY c < 16),
{_ROUND.format(i=0) % 1}, {_ROUND.format(i=1) % 2}, {_ROUND.format(i=2) % 3}, {_ASSIGN.format(i=3)}
SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON a3.c = c3.c""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), r AS (SELECT h, max(page_id) last FROM p GROUP BY h),
s AS (SELECT page_id, h, last, sha1(h) x FROM p JOIN r USING (h))
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 5 * i + 1, 5) AS INTEGER) >> b) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = last OR last IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to FROM s""",
}
