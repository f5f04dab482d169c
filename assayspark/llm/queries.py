"""The operators as queries with production parameters, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayspark.llm import chat, class_lm, exact_dedup, html_extract, lexical_search, license_scan, media, near_dedup, packing, pieces, source_audit, toxicity, url_filter
from assayspark.llm.shared import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("text_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("text_hash", "stays")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op12_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_toxicity, op3_license_scan, op4_media, op5_chat, op6_html_extract, op7_exact_dedup, op8_pieces, op9_best_fit_packing, op10_url_filter, op11_source_audit, op12_class_lm, op13_lexical_search)}

ORACLE_SQL = {
    "op5_chat": r"""
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
      FROM conversations
    ), c AS (
      SELECT conv_id, count(*) AS n_turns, list(struct_pack(role := role, text := text) ORDER BY place) AS turns,
             string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
      FROM t GROUP BY conv_id
    ), g AS (SELECT turns, n_turns, text, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns, n_turns, text)
    SELECT conv_id, n_turns, n_copies, text FROM g
    WHERE NOT EXISTS (SELECT 1 FROM g AS l WHERE l.turns[1] = g.turns[1] AND l.n_turns > g.n_turns AND l.turns[1:g.n_turns] = g.turns)
    """,
    "op7_exact_dedup": r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
      FROM documents
    ), k AS (
      SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size
      FROM d
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
    """,
    "op10_url_filter": r"""
    WITH rules(action, rh, rp) AS (VALUES
      ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
      ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
    ), sites(rh) AS (VALUES ('spam-farm.example.com'), ('spam-farm.example.net'), ('spam-farm.example.org')
    ), u AS (
      SELECT page_id, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS raw,
             coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages
    ), h AS (
      SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u
    ), r AS (
      SELECT h.page_id, h.host, h.path, rules.action, rules.rh || rules.rp AS rule,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(rules.rh || rules.rp) DESC NULLS LAST) AS n
      FROM h LEFT JOIN rules ON (h.host = rules.rh OR ends_with(h.host, '.' || rules.rh)) AND starts_with(h.path, rules.rp)
    )
    SELECT page_id, host, path, rule,
           coalesce(action, CASE WHEN EXISTS (SELECT 1 FROM sites WHERE (r.host = sites.rh OR ends_with(r.host, '.' || sites.rh))
                                             AND starts_with(r.path, '/')) THEN 'block' ELSE 'allow' END) AS verdict
    FROM r WHERE n = 1
    """,
    "op11_source_audit": r"""
    WITH d AS (
      SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
      FROM documents
    ), x AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
    ), kept AS (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT row) >= 3
    ), c AS (SELECT x.lang, x.source, x.term, count(*) AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL
    ), g AS (SELECT DISTINCT lang, source FROM d
    ), v AS (SELECT lang, count(*) AS v, sum(n) AS n_lang FROM kept GROUP BY lang
    ), t AS (
      SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(v.n_lang, 0) AS n_lang, coalesce(sum(c.n), 0) AS n_all
      FROM g LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL
    ), p AS (
      SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (t.n_all + t.v) AS p,
             1 + (1000000000 * (k.n + 1)::HUGEINT) // (t.n_lang + t.v) AS q
      FROM t JOIN kept AS k USING (lang) LEFT JOIN c USING (lang, source, term)
    ), pairs AS (
      SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    ), parts AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
    )
    SELECT lang, source, part, item, value::BIGINT AS value,
           row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM parts QUALIFY part = 'pair' OR rank <= 200
    """,
    "op13_lexical_search": r"""
    WITH d AS (
      SELECT row_number() OVER () AS row, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents
    ), s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
    ), tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL
    ), q AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark
    ), w AS (
      SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs
    ), m AS (SELECT row, doc_id, 100 - 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0
    ), x AS (
      SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL
    )
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM x WHERE score > 0 QUALIFY rank <= 50
    """,
}
