"""The registered queries of this subpackage: thin bindings of the operators to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe_trie, decontamination, hard_negatives, lexical_search, oph_minhash, packing, pii, quality, secret_scan, simhash, token_spans, toxicity, url_aliases
from siftline.llm.blocks import read
from siftline.llm.labelled import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 2), '') path,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 3), '') query
  FROM pages),
l AS (
  SELECT url, host, path, host || path || query a, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?\s*canonical\b[^>]*>', 0),
                   '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?\s*refresh\b[^>]*>', 0),
                   '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;&]*(?:&(?:#?[a-z0-9]+;)?[^"''\s>;&]*)*)', 1)]) raw
  FROM p WHERE host <> ''),
c AS (
  SELECT * EXCLUDE raw, array_to_string(list_transform(string_split(raw, '&'), lambda part, i: CASE
    WHEN i = 1 THEN part
    WHEN starts_with(part, 'amp;') THEN '&' || part[5:] WHEN starts_with(part, 'lt;') THEN '<' || part[4:]
    WHEN starts_with(part, 'gt;') THEN '>' || part[4:] WHEN starts_with(part, 'quot;') THEN '"' || part[6:]
    WHEN starts_with(part, 'apos;') THEN '''' || part[6:]
    WHEN regexp_matches(part, '^#0*[0-9]{1,7};')
      AND (TRY_CAST(regexp_extract(part, '^#0*([0-9]{1,7});', 1) AS INTEGER) BETWEEN 1 AND 55295 OR TRY_CAST(regexp_extract(part, '^#0*([0-9]{1,7});', 1) AS INTEGER) BETWEEN 57344 AND 1114111)
      THEN chr(TRY_CAST(regexp_extract(part, '^#0*([0-9]{1,7});', 1) AS INTEGER)) || regexp_replace(part, '^#0*[0-9]{1,7};', '')
    WHEN regexp_matches(part, '^#[xX]0*[0-9A-Fa-f]{1,6};')
      AND (TRY_CAST('0x' || regexp_extract(part, '^#[xX]0*([0-9A-Fa-f]{1,6});', 1) AS INTEGER) BETWEEN 1 AND 55295
           OR TRY_CAST('0x' || regexp_extract(part, '^#[xX]0*([0-9A-Fa-f]{1,6});', 1) AS INTEGER) BETWEEN 57344 AND 1114111)
      THEN chr(TRY_CAST('0x' || regexp_extract(part, '^#[xX]0*([0-9A-Fa-f]{1,6});', 1) AS INTEGER)) || regexp_replace(part, '^#[xX]0*[0-9A-Fa-f]{1,6};', '')
    ELSE '&' || part END), '') link
  FROM l WHERE raw <> ''),
u AS (
  SELECT a, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN 'x:' || link
    WHEN starts_with(link, '/') THEN 'x://' || host || link
    WHEN starts_with(link, '?') THEN 'x://' || host || path || link
    WHEN starts_with(link, '#') THEN 'x://' || a || link
    ELSE 'x://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || link END raw
  FROM c),
s AS (
  SELECT a, raw, regexp_extract(raw, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 2) way, string_split(way, '/') segments FROM u),
k AS (
  SELECT *, list_reduce(list_transform(segments, lambda x: [x]),
                        lambda kept, x: CASE x[1] WHEN '.' THEN kept WHEN '..' THEN kept[1 : greatest(1, len(kept) - 1)] ELSE list_concat(kept, x) END, []::VARCHAR[]) kept
  FROM s),
t AS (
  SELECT a, CASE WHEN regexp_matches(way, '/\.\.?(/|$)')
    THEN regexp_extract(raw, '(?s)^(.*?://[^/?#]*)', 1)
         || array_to_string(CASE WHEN segments[-1] IN ('.', '..') THEN list_append(kept, '') ELSE kept END, '/')
         || regexp_extract(raw, '(?s)^.*?://[^?#]*(.*)$', 1)
    ELSE raw END target
  FROM k),
e AS (
  SELECT a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
            || regexp_extract(target, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 2)
            || regexp_extract(target, '(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)', 3) b
  FROM t WHERE regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1) <> ''),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
r(decision, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
nodes AS (SELECT DISTINCT other n, regexp_extract(other, '^[^/?#]*') host, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) path FROM reach),
node_rule AS (
  SELECT n, arg_max(decision, length(h || q)) decision FROM nodes
  JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY n),
passed AS (
  SELECT node, bool_or(decision = 'block') AND NOT bool_or(decision = 'allow') blocked
  FROM reach JOIN node_rule ON other = n GROUP BY node),
page_rule AS (
  SELECT host, path, arg_max(h || q, length(h || q)) rule, arg_max(decision, length(h || q)) decision
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL)
SELECT page_id, p.host, p.path, g.rule,
       coalesce(g.decision, CASE WHEN blocked THEN 'block' END, 'allow') verdict
FROM p LEFT JOIN page_rule g ON g.host = p.host AND g.path = p.path
LEFT JOIN passed ON node = p.host || p.path || query AND p.host <> ''
"""


@query("op5_url_aliases", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.judge(read(spark, sf_dir, "pages"))


@query("op6_bpe_trie")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode(read(spark, sf_dir, "documents"))


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op2_token_spans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_spans.by_section(read(spark, sf_dir, "documents"))
    tokens = F.sha2(F.array_join(F.col("section_tokens").cast("array<string>"), ","), 256).alias("sections_sha256")
    return found.select("doc_id", "n_tokens", "n_sections", "n_crossing", "most_tokens", tokens, "ids_sha256")


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') win
  FROM (SELECT rid, w, n, unnest(range(1, greatest(1, len(w) - n + 2))) p
        FROM d, (SELECT DISTINCT n FROM bw) s WHERE len(w) >= n)),
hits AS (SELECT rid, p, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
n_hit AS (
  SELECT rid, count(DISTINCT q) c
  FROM (SELECT rid, unnest(range(p, p + n)) q FROM (SELECT DISTINCT rid, p, n FROM hits)) GROUP BY rid),
n_item AS (
  SELECT rid, count(*) c, string_agg(item, ',' ORDER BY item) ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(h.c, 0) AS BIGINT) n_hit,
       CAST(coalesce(i.c, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256,
       coalesce(h.c, 0) > 0 AND 20 * coalesce(h.c, 0) >= len(w) contaminated
FROM d LEFT JOIN n_hit h USING (rid) LEFT JOIN n_item i USING (rid)
"""


@query("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query("op7_one_permutation_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph_minhash.neighbours(read(spark, sf_dir, "documents"))


@query("op8_nb_svm_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(read(spark, sf_dir, "documents"))


@query("op10_pii_crf")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


@query("op13_concatenate_cut")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pieces(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () rid, doc_id, w, CAST(len(w) AS BIGINT) n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents)
  WHERE len(w) > 0),
s AS (SELECT count(*) big_n, CAST(sum(n) AS BIGINT) big_l FROM d),
q AS (
  SELECT qid, item_id, term, count(*) times
  FROM (SELECT row_number() OVER () qid, item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
        FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (
  SELECT rid, term, count(*) tf FROM (SELECT rid, unnest(w) term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
g AS (
  SELECT rid, term,
         CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) OVER (PARTITION BY term) + 1))) AS BIGINT)
           * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) gain
  FROM p JOIN d USING (rid), s),
r AS (
  SELECT qid, any_value(item_id) item_id, rid, any_value(doc_id) doc_id, CAST(sum(times * gain) AS BIGINT) score
  FROM q JOIN g USING (term) JOIN d USING (rid) GROUP BY qid, rid HAVING sum(times * gain) > 0)
SELECT item_id, CAST(rank AS INTEGER) "rank", doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) rank FROM r) WHERE rank <= 20
"""


@query("op12_block_max_maxscore", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END lab,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () a, * FROM (SELECT DISTINCT * FROM e WHERE vec_id % 50 = 0)),
s AS (
  SELECT a.a, a.vec_id anchor_id, a.lab = e.lab same, e.vec_id, CAST(list_dot_product(a.v, e.v) AS BIGINT) score
  FROM a JOIN e ON a.vec_id <> e.vec_id),
p AS (
  SELECT * FROM (SELECT a, anchor_id, vec_id positive_id, score positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) place
                 FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.*, s.vec_id negative_id, s.score negative_score, row_number() OVER (PARTITION BY p.a, place ORDER BY s.score DESC, s.vec_id) rank
  FROM p JOIN s ON p.a = s.a WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) "rank", negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op11_spanning_tree_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 50 == 0)
