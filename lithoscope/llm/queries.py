"""The queries pN_... of the training-data problems, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoscope.llm import conversations, leakage, neardup, neighbours, prose, sources, splitting, tokenize
from lithoscope.session import table


def p1_paths(spark, d):
    tables = [table(spark, d, t) for t in ("file_paths", "symbols", "code_blocks")]
    return sources.classify_paths(*tables, sources.attribute_files(*tables))


def p1_found(spark, d):
    return p1_paths(spark, d).where("foreign").select("path")


def p3_pairs(spark, d):
    parts = [("code_blocks", "content"), ("symbols", "snippet")]
    out = [neardup.similar_pairs(table(spark, d, t), "content_hash", c).withColumn("src_table", F.lit(t)) for t, c in parts]
    return out[0].unionByName(out[1])


def p3_groups(spark, d):
    """One row for each block and symbol: the class of its text and the number of similar ones."""
    pairs = p3_pairs(spark, d)
    parts = [("code_blocks", "content"), ("symbols", "snippet")]
    out = [neardup.groups(table(spark, d, t), "id", "content_hash", pairs.where(F.col("src_table") == t)).withColumn("src_table", F.lit(t)) for t, c in parts]
    return out[0].unionByName(out[1])


def p3_found(spark, d):
    return p3_pairs(spark, d).select("src_table", "hash_a", "hash_b")


def _records(spark, d):
    path = f"{d}/transcript_rows.parquet"
    return conversations.drain(spark, path, table(spark, d, "transcript_rows").schema)


def p4_found(spark, d):
    return conversations.verdicts(_records(spark, d)).where("broken").select("session_id")


def p4_conversations(spark, d):
    records = _records(spark, d)
    return conversations.conversations(records, conversations.verdicts(records))


def p5_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "code_blocks"))


def p5_check(spark, d):
    """One row: the texts that were cut, and how many of their pieces break a rule; see `splitting.violations`."""
    blocks = table(spark, d, "code_blocks")
    return splitting.violations(blocks, splitting.split_oversized(blocks))


def p5_found(spark, d):
    return p5_pieces(spark, d).select("id").distinct()


def p6_neighbours(spark, d):
    parts = [("block_embeddings", "vec_id"), ("knowledge_embeddings", "id")]
    out = [neighbours.nearest(table(spark, d, t), key).withColumn("src_table", F.lit(t)) for t, key in parts]
    return out[0].unionByName(out[1]).withColumn("similarity", F.round("similarity", 9))


def p6_found(spark, d):
    return neighbours.neighbour_pairs(p6_neighbours(spark, d))


def p7_ids(spark, d):
    return tokenize.encode_corpus(table(spark, d, "documents"), tokenize.default_vocabulary())


def p8_leaks(spark, d):
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark, d):
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_clean(spark, d):
    docs = table(spark, d, "documents")
    return leakage.without_leaks(docs, p8_leaks(spark, d)).select("doc_id", "n_chars")


def p9_quality(spark, d):
    return prose.quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p9_found(spark, d):
    return prose.not_prose(p9_quality(spark, d))


_P4_FOUND = """
WITH kept AS (SELECT * FROM transcript_rows WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, uuid ORDER BY row_id) = 1),
body AS (
  SELECT *, lower(trim(type)) AS role,
    CASE WHEN message IS NULL THEN content
         WHEN NOT json_valid(message) THEN NULL
         WHEN json_type(json_extract(CASE WHEN json_valid(message) THEN message ELSE '{}' END, '$.content')) = 'VARCHAR' THEN json_extract_string(CASE WHEN json_valid(message) THEN message ELSE '{}' END, '$.content')
         WHEN json_type(json_extract(CASE WHEN json_valid(message) THEN message ELSE '{}' END, '$.content')) = 'ARRAY'
         THEN array_to_string([json_extract_string(b, '$.text') FOR b IN CAST(json_extract(CASE WHEN json_valid(message) THEN message ELSE '{}' END, '$.content') AS JSON[]) IF json_extract_string(b, '$.type') = 'text'], ' ')
    END AS text FROM kept),
turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY recorded_at, row_id) AS up, row_number() OVER (PARTITION BY session_id ORDER BY recorded_at DESC, row_id DESC) AS down
  FROM body WHERE role IN ('user', 'assistant') AND regexp_matches(text, '[^\\s]')),
good AS (SELECT session_id FROM turns GROUP BY session_id HAVING max(CASE WHEN up = 1 THEN role END) = 'user' AND max(CASE WHEN down = 1 THEN role END) = 'assistant'),
torn AS (SELECT DISTINCT session_id FROM kept k WHERE parent_uuid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.session_id = k.session_id AND x.uuid = k.parent_uuid))
SELECT DISTINCT session_id FROM kept WHERE session_id NOT IN (SELECT session_id FROM good) OR session_id IN (SELECT session_id FROM torn)
"""

_P6_FOUND = """
WITH v AS (
  SELECT DISTINCT 'b' AS t, vec_id AS id, model, CAST(vector AS DOUBLE[]) AS v FROM block_embeddings WHERE len(vector) = CASE model WHEN 'codevec-s' THEN 64 ELSE 48 END
  UNION ALL SELECT DISTINCT 'k', id, model, CAST(vector AS DOUBLE[]) FROM knowledge_embeddings WHERE len(vector) = 64),
u AS (SELECT * FROM v WHERE list_inner_product(v, v) > 0),
near AS (SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.t = b.t AND a.model = b.model AND a.id != b.id),
top AS (SELECT id, other FROM near WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 5)
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM top
"""

_P8_LEAKS = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
              unnest([array_to_string(w[i:i + least(13, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(13, len(w)) + 2)]) AS g
       FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM ig),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
dg AS (SELECT doc_id, n, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, greatest(1, len(w) - n + 2))]) AS g FROM dw, sizes),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (n, g))
"""


_P3 = """
src AS (SELECT DISTINCT 'code_blocks' AS t, content_hash AS h, content AS x FROM code_blocks WHERE content IS NOT NULL AND content_hash IS NOT NULL
  UNION SELECT 'symbols', content_hash, snippet FROM symbols WHERE snippet IS NOT NULL AND content_hash IS NOT NULL),
w AS (SELECT t, h, regexp_extract_all(lower(x), '[A-Za-z0-9_]+') AS w FROM src),
g AS (SELECT DISTINCT t, h, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 30),
n AS (SELECT t, h, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT a.t, a.h AS a, b.h AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.g = b.g AND a.h < b.h GROUP BY ALL),
pair AS (SELECT c.t, a, b, c / (x.n + y.n - c)::DOUBLE AS s FROM c JOIN n x ON x.t = c.t AND x.h = a JOIN n y ON y.t = c.t AND y.h = b WHERE c / (x.n + y.n - c)::DOUBLE >= 0.6 - 1e-12)
"""
_P3_GROUPS = "WITH RECURSIVE " + _P3 + """,
ways AS (SELECT t, a AS u, b AS v FROM pair UNION SELECT t, b, a FROM pair),
reach AS (SELECT t, u, u AS v FROM ways UNION SELECT r.t, r.u, w.v FROM reach r JOIN ways w ON w.t = r.t AND w.u = r.v),
comp AS (SELECT t, u, min(v) AS class FROM reach GROUP BY ALL), links AS (SELECT t, u, count(*) AS n FROM ways GROUP BY ALL),
rows_ AS (SELECT 'code_blocks' AS t, id, content_hash AS h FROM code_blocks UNION ALL SELECT 'symbols', id, content_hash FROM symbols)
SELECT r.t AS src_table, r.id, r.h AS hash, coalesce(class, r.h) AS class, coalesce(n, 0) AS n_links FROM rows_ r LEFT JOIN comp ON comp.t = r.t AND comp.u = r.h LEFT JOIN links ON links.t = r.t AND links.u = r.h
"""
_P4_TURNS = _P4_FOUND.rsplit("SELECT DISTINCT session_id FROM kept WHERE", 1)[0] + """SELECT session_id, CAST(up - 1 AS INT) AS turn, role, text, recorded_at FROM turns WHERE session_id IN (SELECT session_id FROM good) AND session_id NOT IN (SELECT session_id FROM torn)"""
_P6_ALL = _P6_FOUND.split("top AS")[0].replace("SELECT a.id, b.id AS other", "SELECT a.t, a.model, a.id, b.id AS other") + """top AS (SELECT t, model, id, other, s, row_number() OVER (PARTITION BY t, model, id ORDER BY round(s, 12) DESC, other) AS r FROM near WHERE s >= 0.85 - 1e-12 QUALIFY r <= 5)
SELECT CASE t WHEN 'b' THEN 'block_embeddings' ELSE 'knowledge_embeddings' END AS src_table, model, id, other, round(s, 9) AS similarity, CAST(r AS INT) AS rank FROM top
"""
# runs of matching n-word windows along a diagonal are one passage
_P8_LONGEST = """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL),
ig AS (SELECT item_id, n, i - 1 AS ip, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM ig),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
dg AS (SELECT doc_id, n, i - 1 AS dp, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - n + 2))) AS i FROM dw, sizes)),
hit AS (SELECT doc_id, item_id, n, dp, ip, dp - row_number() OVER (PARTITION BY doc_id, item_id, dp - ip ORDER BY dp) AS isle FROM dg JOIN ig USING (n, g)),
runs AS (SELECT doc_id, item_id, min(dp) AS dp, min(ip) AS ip, any_value(n) + count(*) - 1 AS len FROM hit GROUP BY doc_id, item_id, dp - ip, isle)
SELECT doc_id, item_id, dp AS doc_word, ip AS item_word, len AS n_words FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len DESC, dp, ip) = 1
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_paths": p1_paths, "p3_found": p3_found, "p3_pairs": p3_pairs, "p3_groups": p3_groups, "p4_found": p4_found, "p4_conversations": p4_conversations,
            "p5_found": p5_found, "p5_pieces": p5_pieces, "p5_check": p5_check, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p8_clean": p8_clean,
            "p9_found": p9_found, "p9_quality": p9_quality}


def oracle_sql() -> dict:
    return {
        "p3_found": "WITH " + _P3 + "SELECT t AS src_table, a AS hash_a, b AS hash_b FROM pair",
        "p3_pairs": "WITH " + _P3 + "SELECT t AS src_table, a AS hash_a, b AS hash_b, s AS similarity FROM pair",
        "p3_groups": _P3_GROUPS,
        "p4_conversations": _P4_TURNS,
        "p5_check": "SELECT count(DISTINCT (id, content)) AS texts, 0::BIGINT AS too_long, 0::BIGINT AS overlap_too_long, 0::BIGINT AS gaps, 0::BIGINT AS wrong_text, 0::BIGINT AS wrong_line, 0::BIGINT AS not_whole_lines FROM code_blocks WHERE length(content) > 2000",
        "p6_neighbours": _P6_ALL,
        "p8_leaks": _P8_LONGEST,
        "p4_found": _P4_FOUND,
        "p5_found": "SELECT DISTINCT id FROM code_blocks WHERE length(content) > 2000",
        "p6_found": _P6_FOUND,
        "p8_found": _P8_LEAKS + "SELECT doc_id, item_id FROM hit",
        "p8_clean": _P8_LEAKS + "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
    }
