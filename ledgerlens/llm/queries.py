"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.decontamination import contamination_digest
from ledgerlens.llm.filter_audit import audit_filters
from ledgerlens.llm.language_id import predict_languages
from ledgerlens.llm.line_dedup import line_report
from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.multiset_fingerprint import fingerprint_edits
from ledgerlens.llm.near_dedup import near_duplicates
from ledgerlens.llm.pii import detect, digest_spans
from ledgerlens.llm.quality_rules import quality_report
from ledgerlens.llm.source_divergence import audit_sources
from ledgerlens.llm.substring_dedup import remove_repeated_strings
from ledgerlens.llm.text import table
from ledgerlens.llm.url_rules import judge_urls
from ledgerlens.llm.warc import captures_of_pages, headers_text, resolve_revisits

LLM_QUERIES: dict = {}
LLM_ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        LLM_QUERIES[name] = fn
        if sql:
            LLM_ORACLES[name] = sql
        return fn
    return keep


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@_query("op5_url_filter", """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM parts LEFT JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE nth = 1
""")
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, rule_verdict string")
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


@_query("op6_source_mix", r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM per
  WINDOW f AS (ORDER BY (3 * source_size)::DOUBLE / weight, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         least((3 * source_size)::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM levels),
dealt AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY r.round, md5('mix-1:' || r.round || ':' || s.doc_id)
                           ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (1), (2), (3)) r(round))
SELECT doc_id, any_value(size)::BIGINT AS size, any_value(source_size)::BIGINT AS source_size,
       any_value(target) AS target,
       sum(greatest(0, least(size, floor(target)::BIGINT - before)))::BIGINT AS taken
FROM dealt GROUP BY doc_id
""")
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_query("op4_multiset_fingerprint")
def op4_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op10_revisit_resolution", r"""
WITH pieces AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, regexp_extract(url, '://([^#]*)', 1) AS rest FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(
           translate(regexp_extract(rest, '^([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '^.*@', ''), ':(80|443)$', ''), '^www[.]', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/(index[.]html?)?$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '[?](.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(ref|utm_[a-z]+|gclid|fbclid|sessionid|sid)(=|$)'))), '&') AS query
  FROM pieces),
canon AS (
  SELECT page_id, md5(html) AS tag, sha256(html) AS digest, strlen(html) AS n_bytes,
         1700000000 + 60 * page_id AS seen_at,
         1700000030 + 60 * page_id + 3600 * (('0x' || substr(md5(url), 1, 4))::BIGINT % 7 + 1) AS revisited_at,
         CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
  FROM parts),
joined AS (
  SELECT v.*, r.page_id AS r_id, r.tag AS r_tag, r.digest AS r_digest, r.n_bytes AS r_bytes, r.seen_at AS r_at,
         row_number() OVER (PARTITION BY v.page_id ORDER BY r.seen_at DESC) AS nth
  FROM canon v LEFT JOIN canon r ON v.canonical_url = r.canonical_url AND r.seen_at < v.revisited_at),
revisits AS (
  SELECT *, CASE WHEN r_id IS NULL THEN 'no_response' WHEN tag = r_tag THEN 'resolved' ELSE 'changed' END AS outcome
  FROM joined WHERE nth = 1),
lines AS (
  SELECT *, strftime(make_timestamp(seen_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS seen_date,
         strftime(make_timestamp(revisited_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS date FROM revisits)
SELECT 2 * page_id AS record_id, 'response' AS warc_type, canonical_url, 'response' AS outcome,
       NULL::BIGINT AS refers_to, 2 * page_id AS payload_of, 200 AS status, digest AS resolved_digest,
       'content-length: ' || n_bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || seen_date || chr(10)
       || 'etag: "' || tag || '"' AS merged_headers
FROM lines
UNION ALL
SELECT 2 * page_id + 1, 'revisit', canonical_url, outcome, 2 * r_id,
       CASE WHEN outcome = 'resolved' THEN 2 * r_id END, 304, CASE WHEN outcome = 'resolved' THEN r_digest END,
       'cache-control: max-age=3600' || chr(10)
       || CASE WHEN outcome = 'resolved' THEN 'content-length: ' || r_bytes || chr(10) || 'content-type: text/html'
               ELSE 'content-length: 0' END
       || chr(10) || 'date: ' || date || chr(10) || 'etag: W/"' || tag || '"'
FROM lines
""")
def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = captures_of_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return resolve_revisits(captures).select(
        "record_id", "warc_type", "canonical_url", "outcome", "refers_to", "payload_of", "status",
        "resolved_digest", headers_text(F.col("merged_headers")).alias("merged_headers"))


@_query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_spans(detect(table(spark, sf_dir, "documents", "doc_id", "text")))


@_query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@_query("op2_line_dedup", r"""
WITH texts AS (
  SELECT doc_id, text, md5(text) AS key, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS lines,
         string_split(text, chr(10)) AS raw FROM documents),
starts AS (SELECT doc_id, key, lines, unnest(range(0, len(lines) - 2)) AS pos FROM texts WHERE len(lines) >= 3),
windows AS (
  SELECT doc_id, key, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS w FROM starts),
real AS (SELECT *, min((doc_id, key, pos)) OVER (PARTITION BY w) AS first FROM windows WHERE regexp_matches(w, '[\p{L}\p{N}]')),
covered AS (
  SELECT doc_id, key, list(DISTINCT line) AS covered
  FROM (SELECT doc_id, key, unnest([pos, pos + 1, pos + 2]) AS line FROM real WHERE (doc_id, key, pos) <> first)
  GROUP BY doc_id, key)
SELECT doc_id, coalesce(len(raw), 0)::INT AS n_lines, coalesce(len(covered), 0)::INT AS n_removed,
       sha256(CASE WHEN covered IS NULL THEN coalesce(text, '')
              ELSE array_to_string([raw[i + 1] for i in range(0, len(raw)) if NOT list_contains(covered, i)], chr(10)) END) AS kept_sha256
FROM texts LEFT JOIN covered USING (doc_id, key)
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op7_decontamination", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[s : s + 9] AS words, len(w[s : s + 9]) AS width
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
spots AS (
  SELECT doc_id, s, width, w[s : s + width - 1] AS words
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM d, widths)),
found AS (SELECT doc_id, s, spots.width, item_id FROM spots JOIN windows USING (words)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS pos FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids
  FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents", "doc_id", "text"),
                                table(spark, sf_dir, "benchmark", "item_id", "text"))


@_query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query("op11_source_divergence", r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
used AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc_id) AS docs
  FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM d) GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM used GROUP BY lang, term HAVING sum(docs) >= 3),
langs AS (SELECT lang, sum(n)::BIGINT AS size, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
sizes AS (SELECT lang, source, sum(n)::BIGINT AS size FROM cells GROUP BY lang, source),
shares AS (
  SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 1)) // (s.size + l.v) AS p
  FROM cells c JOIN sizes s ON c.lang = s.lang AND c.source = s.source JOIN langs l ON c.lang = l.lang),
whole AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n + 1)) // (l.size + l.v) AS q FROM kept k JOIN langs l ON k.lang = l.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (
  SELECT s.lang, s.source, s.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""")
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents", "text", "lang", "source"))


@_query("op12_quality_rules", r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         regexp_extract_all(lower(coalesce(text, '')), '\p{L}+') AS t,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (SELECT doc_id, words FROM windows GROUP BY doc_id, words HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT pos) AS n
             FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM windows JOIN again USING (doc_id, words)) GROUP BY doc_id),
classes AS (
  SELECT doc_id, lang, 'upper' AS bin, len(regexp_extract_all(text, '[A-Z]')) AS n FROM d UNION ALL
  SELECT doc_id, lang, 'digit', len(regexp_extract_all(text, '[0-9]')) FROM d UNION ALL
  SELECT doc_id, lang, 'space', len(regexp_extract_all(text, '[\x20\x09-\x0D]')) FROM d UNION ALL
  SELECT doc_id, lang, 'punctuation', len(regexp_extract_all(text, '[.,;:!?''"()-]')) FROM d UNION ALL
  SELECT doc_id, lang, 'symbol', len(regexp_extract_all(text, '[#$%&*+/<=>@\[\\\]^_`{|}~\x00-\x08\x0E-\x1F\x7F]')) FROM d UNION ALL
  SELECT doc_id, lang, 'other', len(regexp_extract_all(text, '[^\x00-\x7F]')) FROM d UNION ALL
  SELECT doc_id, lang, 'lower', len(regexp_extract_all(text, '[a-z]')) FROM d),
usual AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes WHERE lang IS NOT NULL GROUP BY lang, bin),
chars AS (SELECT doc_id, sum(n) AS n FROM classes GROUP BY doc_id),
class_js AS (
  SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM (SELECT c.doc_id, c.n / greatest(chars.n, 1) AS p, u.q FROM classes c JOIN chars ON c.doc_id = chars.doc_id
        JOIN usual u ON c.lang = u.lang AND c.bin = u.bin) GROUP BY doc_id),
tokens AS (SELECT doc_id, lang, unnest(t) AS word FROM d WHERE lang IS NOT NULL),
counted AS (SELECT lang, word, count(*) AS n FROM tokens GROUP BY lang, word),
sizes AS (SELECT lang, sum(n) AS n FROM counted GROUP BY lang HAVING sum(n) >= 1000),
common AS (
  SELECT c.lang, c.word, c.n / s.n AS q FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM counted) c
  JOIN sizes s ON c.lang = s.lang WHERE rank <= 100),
wholes AS (SELECT lang, sum(q) AS q FROM common GROUP BY lang),
bins AS (
  SELECT t.doc_id, t.lang, t.word, count(*) / any_value(len(d.t)) AS p, any_value(c.q) AS q
  FROM tokens t JOIN common c ON t.lang = c.lang AND t.word = c.word JOIN d ON t.doc_id = d.doc_id GROUP BY ALL),
own AS (SELECT doc_id, sum(p) AS p, sum(q) AS q, sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q))) AS gained FROM bins GROUP BY doc_id),
rest AS (
  SELECT d.doc_id, greatest(0, 1 - coalesce(own.p, 0)) AS p, greatest(0, 1 - wholes.q) AS q,
         coalesce(own.gained, 0) + wholes.q - coalesce(own.q, 0) AS gained
  FROM d JOIN wholes ON d.lang = wholes.lang LEFT JOIN own ON d.doc_id = own.doc_id),
word_js AS (
  SELECT doc_id, sqrt(greatest(0, gained + CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
                                         + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS js FROM rest),
base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         chars.n AS chars, len(t) AS letter_words, c.js AS class_js, v.js AS word_js, sizes.n IS NOT NULL AS known
  FROM d JOIN chars ON d.doc_id = chars.doc_id LEFT JOIN repeated r ON d.doc_id = r.doc_id
  LEFT JOIN class_js c ON d.doc_id = c.doc_id LEFT JOIN word_js v ON d.doc_id = v.doc_id LEFT JOIN sizes ON d.lang = sizes.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words
            OR (known AND chars >= 200 AND class_js > 0.15 + 3.0 / sqrt(chars))
            OR (known AND letter_words >= 50 AND word_js > 0.10 + 4.0 / sqrt(letter_words))) AS kept
FROM base
""")
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_report(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.drop("key", "class_distance", "word_distance")


@_query("op13_filter_audit", r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
tests AS (
  SELECT d.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_extract_all(d.text, '[A-Z]')) > 2 * length(d.text) AS c, regexp_matches(d.text, '[#$%&*|]') AS d,
         d.doc_id > first AS e
  FROM d JOIN firsts ON d.text = firsts.text),
fails AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS mask,
         count(*) AS n, count(*) FILTER (t.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
         count(*) FILTER (t.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
  FROM tests t GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x)
  JOIN letters d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS f, substr(filter_order, 1, s - 1) AS earlier
          FROM orders, (VALUES (1), (2), (3), (4), (5)) t(s)),
cells AS (
  SELECT part, filter_order, step, f, n, good, toxic, mask, contains(mask, f) AS failing,
         len(translate(mask, earlier, '')) < len(mask) AS gone FROM fails, steps),
counts AS (
  SELECT part, filter_order, step, f, sum(n) FILTER (NOT gone AND NOT failing) AS kept, sum(n) FILTER (failing AND NOT gone) AS removed,
         sum(n) FILTER (failing AND gone) AS redundant, sum(n) FILTER (mask = f) AS unique_fails,
         sum(good) FILTER (failing AND NOT gone) AS good_lost, sum(toxic) FILTER (failing AND NOT gone) AS toxic_lost
  FROM cells GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counts
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
