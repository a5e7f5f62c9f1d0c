"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, lexical_search, line_dedup, near_dedup, nearest, packing, prefix_trie, quality,
               substring_dedup, suffix_dedup, topk_search, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rules of the query op2, fixed values.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Turns that the query op8 adds, fixed values.
EXTRA_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_url_filter", """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


@query("op8_chat_format")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_windows(turns.unionByName(extra)))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                  with_ids=False)


@query("op10_decontamination", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), asked AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS said
  FROM (SELECT item_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(1, len(w) - 9) + 1) END) AS i FROM items)
), found AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS said
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM asked))
), hits AS (
  SELECT f.doc_id, f.i, f.n, a.item_id FROM found f JOIN asked a ON a.said = f.said AND a.n = f.n
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN owners o ON o.doc_id = w.doc_id
""")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(decontaminate.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op1_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), trimmed AS (
  SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS said FROM lines
), places AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, said FROM trimmed WHERE said <> ''
), runs AS (
  SELECT a.doc_id, a.place, a.said || chr(10) || b.said AS run
  FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.place = a.place + 1
), later AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, row_number() OVER (PARTITION BY run ORDER BY doc_id, place) AS n FROM runs) WHERE n > 1
), passages AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY said ORDER BY doc_id, place) AS n
    FROM places WHERE len(regexp_extract_all(said, '[^\x20\x09-\x0D]+')) >= 50) WHERE n > 1
), gone AS (
  SELECT p.doc_id, p.pos FROM places p JOIN later l
    ON p.doc_id = l.doc_id AND p.place BETWEEN l.place AND l.place + 1
  UNION
  SELECT doc_id, pos FROM passages
)
SELECT t.doc_id, count(*) FILTER (t.said <> '') AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (g.pos IS NULL), '')) AS kept_sha256
FROM trimmed t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.pos = g.pos
GROUP BY t.doc_id
""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=["doc_id"]).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


@query("op3_near_dedup", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM words
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM places
), sizes AS (
  SELECT w.doc_id, count(s.shingle) AS n FROM words w LEFT JOIN shingles s ON s.doc_id = w.doc_id GROUP BY w.doc_id
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other
)
SELECT s.doc_id, s.n AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
""")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query("op7_suffix_dedup", r"""
WITH bytes AS (
  SELECT doc_id, encode(coalesce(text, '')) AS data, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, i, data[i + 1:i + 50] AS said
  FROM (SELECT doc_id, data, unnest(range(0, octet_length(data) - 49)) AS i FROM bytes)
), firsts AS (
  SELECT said, min(doc_id) AS first FROM starts GROUP BY said
), later AS (
  SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -51) AS before
  FROM starts JOIN firsts USING (said) WHERE first < doc_id
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT *, sum((i - before > 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM later) GROUP BY doc_id, span
), kept AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM spans
), parts AS (
  SELECT k.doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head, max(b) AS past,
         count(*) AS n_spans, sum(b - a) AS n_removed
  FROM kept k JOIN bytes USING (doc_id) GROUP BY k.doc_id
)
SELECT x.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(past, 0) + 1))) AS kept_sha256
FROM bytes x LEFT JOIN parts p ON p.doc_id = x.doc_id
""")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_later_copies(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_substring_dedup", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS said
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words)
), twice AS (
  SELECT said FROM windows GROUP BY said HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows JOIN twice USING (said)
), each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
)
SELECT w.doc_id, any_value(len(w.w)) AS n_words, count(g.i) AS n_removed,
       sha256(coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM words w LEFT JOIN each e ON e.doc_id = w.doc_id LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
GROUP BY w.doc_id
""")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_topk_search", """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 10
""")
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def _crc_case(ids: str) -> str:
    """crc32(decimal id) mod 4 in DuckDB SQL, bit by bit over the digits (it has no crc32)."""
    return f"""
  SELECT id, xor(crc, 4294967295) % 4 AS h FROM (
    SELECT id, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
                           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[]),
                                                         lambda x, i: xor(x >> 1, (x % 2) * 3988292384::UBIGINT))) AS crc
    FROM ({ids}))"""


@query("op13_prefix_trie", rf"""
WITH said AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT id AS conv_id, h FROM ({_crc_case('SELECT DISTINCT conv_id AS id FROM said')})
), rebuilt AS (
  SELECT c.conv_id, s.place, s.role, s.text FROM convs c JOIN said s ON s.conv_id = c.conv_id - c.conv_id % 20 AND s.place <= c.h
  UNION ALL
  SELECT c.conv_id, s.place, s.role, s.text FROM convs c JOIN said s ON s.conv_id = c.conv_id AND s.place > c.h
), chains AS (
  SELECT conv_id, list(sha256(role || chr(10) || text) ORDER BY place) AS chain,
         list(len(regexp_extract_all(text, '[^ 	-
]+')) ORDER BY place) AS words
  FROM rebuilt GROUP BY conv_id
), whole AS (
  SELECT c.conv_id, coalesce(chain, []) AS chain, coalesce(words, []) AS words FROM convs c LEFT JOIN chains x ON x.conv_id = c.conv_id
), members AS (
  SELECT conv_id, d AS depth, array_to_string(chain[1:d], '') AS node, array_to_string(chain[1:d - 1], '') AS parent,
         CASE WHEN d = 0 THEN 0 ELSE words[d] END AS words, len(chain) = d AS ends
  FROM (SELECT *, unnest(range(0, len(chain) + 1)) AS d FROM whole)
), nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), children AS (
  SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), below AS (
  SELECT node[1:64 * d] AS node, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT n.node, n.n_convs, n.words, c.n IS NULL AS leaf, unnest(range(0, n.depth + 1)) AS d
        FROM nodes n LEFT JOIN children c ON c.node = n.node)
  GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.parent LEFT JOIN children c ON c.node = n.node JOIN below b ON b.node = n.node
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base_of=lambda c: c - c % 20,
                                    head_of=lambda c: F.crc32(c.cast("string")) % 4)
    return found.drop("turn_source", "turn_place")


@query("op11_lexical_search", r"""
WITH said AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM said WHERE len(w) > 0
), times AS (
  SELECT row, doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM said) WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM times, total GROUP BY term
), impacts AS (
  SELECT row, doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS impact
  FROM times t JOIN weights USING (term), total
), scores AS (
  SELECT item_id, row, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, row, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_nearest")
def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
