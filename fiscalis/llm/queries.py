"""The operators bound to their tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table
from .decontamination import contaminated_words, contamination_digest
from .embedding_dedup import similar_vectors
from .language_id import fit_languages, predict_languages
from .lm_scoring import fit_model, score_texts, word_counts
from .minhash_dedup import near_duplicates
from .prefix_trie import end_digests, ordered_turns, prefix_trie, rebuilt_turns
from .quality import fit_quality, score_quality
from .registry import LLM_QUERIES, query
from .secret_scan import find_secrets, secret_digest
from .sentencepiece_scan import encode_texts, load_vocabulary
from .source_divergence import source_divergence
from .substring_dedup import remove_repeats
from .topk_search import top_products
from .url_filters import judge_urls

__all__ = ["LLM_QUERIES"]

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("op5_url_filters", """
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
SELECT page_id, host, path,
  CASE WHEN o AND starts_with(path, '/') AND e AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN o AND e AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN c AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN c AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN o AND starts_with(path, '/') THEN 'org/' END AS rule,
  CASE WHEN e AND (starts_with(path, '/en/1') OR starts_with(path, '/es/')) THEN 'block'
       WHEN c AND starts_with(path, '/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, host = 'org' OR ends_with(host, '.org') AS o, host = 'com' OR ends_with(host, '.com') AS c,
             host = 'example.org' OR ends_with(host, '.example.org') AS e FROM cut)
""")
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op10_decontamination", r"""
WITH words AS (
  SELECT doc_id AS id, true AS doc, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents)
  UNION ALL
  SELECT item_id, false, unnest(w), generate_subscripts(w, 1), len(w) FROM (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)),
runs AS (
  SELECT id, doc, i, n, word, string_agg(word, ' ') OVER (PARTITION BY doc, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM words),
wins AS (SELECT DISTINCT id AS item_id, run, least(n, 10) AS size FROM runs WHERE NOT doc AND (i + 9 <= n OR n < 10 AND i = 1)),
sizes AS (SELECT DISTINCT size FROM wins),
occ AS (
  SELECT r.id AS doc_id, r.i, w.item_id, w.size FROM runs r JOIN wins w ON w.size = 10 AND r.run = w.run WHERE r.doc AND r.i + 9 <= r.n
  UNION ALL
  SELECT r.id, r.i, w.item_id, w.size FROM runs r JOIN sizes s ON s.size < 10 AND r.i + s.size - 1 <= r.n
    JOIN wins w ON w.size = s.size AND array_to_string(string_split(r.run, ' ')[1:s.size], ' ') = w.run WHERE r.doc),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM (SELECT DISTINCT doc_id, i, size FROM occ)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY 1),
n AS (SELECT id AS doc_id, count(*) AS n_words FROM words WHERE doc GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True))


@query("op6_secret_scans")
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op9_minhash_near_dedup")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_embedding_near_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
           AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM linked GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)
""")
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS run FROM spot),
first AS (SELECT run, min(doc_id) AS low FROM win GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN first USING (run) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_languages(docs.where(~held_out))
    return predict_languages(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out), "doc_id")
    return score_quality(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


@query("op2_lm_scoring")
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    training = docs.where(~held_out).select("text")
    counts = word_counts(training)
    return score_texts(docs, fit_model(training, counts), counts, [F.col("doc_id"), held_out.alias("held_out")])


@query("op4_sentencepiece")
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents"), load_vocabulary(), [F.col("doc_id")], digest=True)
    return coded.select("doc_id", "n_pieces", "score", F.col("ids").alias("ids_sha256"), "round_trip")


@query("op13_conversation_trie", r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS t
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, n, c - c % 20 AS b, (4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, (u & 1) * 3988292384)))) % 4 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c)),
built AS (
  SELECT v.c, t.i + 1 AS d, r, t FROM convs v JOIN turns t ON t.c = v.b AND t.i < v.h
  UNION ALL
  SELECT v.c, least(v.h, coalesce(w.n, 0)) + t.i - v.h + 1, r, t FROM convs v LEFT JOIN convs w ON w.c = v.b JOIN turns t ON t.c = v.c AND t.i >= v.h),
pre AS (
  SELECT c, 0 AS d, [] AS p FROM convs
  UNION ALL SELECT c, d, list({'r': r, 't': t}) OVER (PARTITION BY c ORDER BY d) FROM built),
nodes AS (SELECT d, p, min(c) AS conv, count(*) AS n FROM pre GROUP BY d, p),
mem AS (SELECT pre.c, pre.d, conv FROM pre JOIN nodes USING (d, p)),
tree AS (
  SELECT n.conv, n.d, n.n, m.conv AS parent, CASE WHEN n.d = 0 THEN 0 ELSE len(regexp_extract_all(n.p[n.d].t, '[^\x20\x09-\x0D]+')) END AS w
  FROM nodes n LEFT JOIN mem m ON m.c = n.conv AND m.d = n.d - 1),
kids AS (SELECT parent AS conv, d - 1 AS d, count(*) AS k FROM tree WHERE d > 0 GROUP BY ALL),
own AS (SELECT t.*, coalesce(k, 0) AS k FROM tree t LEFT JOIN kids USING (conv, d)),
sums AS (SELECT m.conv, m.d, count(*) FILTER (k = 0) AS leaves, sum((o.n - 1) * w) AS saved FROM own o JOIN mem m ON m.c = o.conv AND m.d <= o.d GROUP BY ALL),
ends AS (
  SELECT conv, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT mem.*, max(d) OVER (PARTITION BY c) AS last FROM mem) WHERE d = last GROUP BY ALL)
SELECT conv AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n::BIGINT AS n_convs, k::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN sums USING (conv, d) LEFT JOIN ends USING (conv, d)
""")
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefix_trie(*rebuilt_turns(ordered_turns(table(spark, sf_dir, "conversations"))))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(end_digests(ends), ["pos", "x1", "x2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


@query("op11_topk_search", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, p.e) DESC, p.vec_id)::INT AS rank,
       p.vec_id, list_inner_product(q.e, p.e)::BIGINT AS score
FROM v q JOIN v p ON q.vec_id <> p.vec_id AND q.vec_id % 50 = 0 QUALIFY rank <= 5
""")
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


@query("op12_source_divergence", r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM tok GROUP BY ALL HAVING count(DISTINCT id) >= 10),
grp AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tok GROUP BY ALL),
all_p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p
  FROM (SELECT lang, source, term, coalesce(s.n, 0::HUGEINT) AS n FROM grp JOIN (SELECT lang, term FROM kept) USING (lang) LEFT JOIN seen s USING (lang, source, term))),
all_q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM kept),
vs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM all_p a JOIN all_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN vs ON vs.lang = a.lang AND vs.source = a.source AND vs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM all_p JOIN all_q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
