"""Queries of search, listings, graph and findings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoscope.operators import browse, search
from lithoscope.operators.textindex import TextIndex
from lithoscope.plans.index import UNDER, VIEWS, CodeIndex
from lithoscope.session import scratch_path

QUERY = "queue return"
#: The indexes that this driver has built, by application and data folder.
_BUILT: dict[tuple[str, str], tuple[TextIndex, TextIndex]] = {}


def indexes(ix: CodeIndex) -> tuple[TextIndex, TextIndex]:
    """The full-text indexes of symbols and blocks of a data folder: built at the first query, kept for the others."""
    key = (ix.spark.sparkContext.applicationId, ix.folder)
    if key not in _BUILT:
        symbols = TextIndex(ix.spark, scratch_path(ix.spark, "symbol-index"), 16).build(ix.symbols, "id", ["name", "description"])
        blocks = TextIndex(ix.spark, scratch_path(ix.spark, "block-index"), 16).build(ix.blocks.where("content is not null"), "id", ["content"])
        _BUILT[key] = (symbols, blocks)
    return _BUILT[key]


def _vector(ix):
    row = ix.raw("block_embeddings").where("model = 'codevec-s' and vector is not null and size(vector) = 64").orderBy("vec_id").select("vector").first()
    return list(row["vector"]) if row else [1.0] * 64


def vector_topk(spark, d):
    ix = CodeIndex(spark, d)
    return search.top(search.vector_scores(ix, ix.raw("block_embeddings"), _vector(ix), "codevec-s"), 100).select("doc", F.round("score", 6).alias("score"))


def bm25_symbols(spark, d):
    return indexes(CodeIndex(spark, d))[0].bm25("the planner").select("doc", F.round("score", 9).alias("score"))


def bm25_blocks(spark, d):
    return indexes(CodeIndex(spark, d))[1].bm25(QUERY).select("doc", F.round("score", 9).alias("score"))


def bm25_scan(spark, d):
    """The same without an index."""
    return search.bm25(CodeIndex(spark, d).blocks.where("content is not null"), "id", ["content"], QUERY).select("doc", F.round("score", 9).alias("score"))


def bm25_updated(spark, d):
    """After an update: half of the blocks were indexed first, some of them with another text; some blocks were removed."""
    b = CodeIndex(spark, d).blocks.where("content is not null")
    old = b.where("id % 2 = 0 or id % 5 = 0").withColumn("content", F.when(F.col("id") % 5 == 0, "queue queue return").otherwise(F.col("content")))
    index = TextIndex(spark, scratch_path(spark, "updated-index"), 4).build(old, "id", ["content"])
    index.update(b.where("id % 2 = 1 or id % 5 = 0"), "id", ["content"])
    index.update(b.where("false"), "id", ["content"], b.where("id % 7 = 0").select(F.col("id").alias("doc")))
    return index.bm25(QUERY).select("doc", F.round("score", 9).alias("score"))


def hybrid_compat(spark, d):
    """Ranks and weights per row, as the original counts them."""
    ix = CodeIndex(spark, d)
    return search.hybrid_search(ix, ix.raw("block_embeddings"), QUERY, _vector(ix), 20, "codevec-s", indexes=indexes(ix), compat=True).select("doc", F.round("score", 9).alias("score"))


def hybrid_search(spark, d):
    ix = CodeIndex(spark, d)
    return search.hybrid_search(ix, ix.raw("block_embeddings"), QUERY, _vector(ix), 20, "codevec-s", indexes=indexes(ix)).select("doc", "kind", "name", "path", F.round("score", 9).alias("score"))


def hybrid_filtered(spark, d):
    ix = CodeIndex(spark, d)
    return search.hybrid_search(ix, ix.raw("block_embeddings"), "return", None, 20, exts=(".py", ".go"), directory="/src/", tags=None, indexes=indexes(ix)).select("doc", "path", search.compact_hit().alias("text"), F.round("score", 9).alias("score"))


def retrieval_metrics(spark, d):
    """Known-item search: each vector's label-mate ranking among its nearest by cosine."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("v"))
    first = e.groupBy("label").agg(F.min("vec_id").alias("target"))
    t = e.join(first, e.vec_id == first.target).select("target", F.col("v").alias("tv"))
    from lithoscope.functions.vectors import cosine
    from lithoscope.session import bounded_broadcast

    # one row per label: a stated set of targets that every vector is ranked against
    ranked = e.join(first, "label").where("vec_id != target").crossJoin(bounded_broadcast(t.withColumnRenamed("target", "other"), 10_000))
    s = ranked.select("vec_id", "target", "other", F.round(cosine("v", "tv"), 9).alias("s"))
    mine = s.where("other = target").select("vec_id", F.col("s").alias("m"))
    rank = s.join(mine, "vec_id").groupBy("vec_id").agg((F.count(F.when((F.col("s") > F.col("m")) | ((F.col("s") == F.col("m")) & (F.col("other") < F.col("target"))), 1)) + 1).alias("rank"))
    return search.retrieval_metrics(rank).select(F.round("p_at_1", 9).alias("p_at_1"), F.round("mrr", 9).alias("mrr"))


def hybrid_verbose(spark, d):
    ix = CodeIndex(spark, d)
    hits = search.hybrid_search(ix, ix.raw("block_embeddings"), "return", None, 20, exts=(".py", ".go"), directory="/src/", tags=None, indexes=indexes(ix))
    return search.verbose_hits(ix, hits, refs=True)


def snippet_text(spark, d):
    ix = CodeIndex(spark, d)
    return search.snippet_search(ix, ix.raw("block_embeddings"), "return", None, "/src/", 10).select(F.md5("text").alias("text_md5"))


def hybrid_reranked(spark, d):
    ix = CodeIndex(spark, d)
    best = lambda rows: sorted(range(len(rows)), key=lambda i: (rows["name"][i], rows["doc"][i]))[:5]
    return search.hybrid_search(ix, ix.raw("block_embeddings"), "return", None, 20, exts=(".py", ".go"), directory="/src/", rerank=best, indexes=indexes(ix)).select("doc", "position")


def scope_of_both_slashes(spark, d):
    return CodeIndex(spark, d, directory="K:/code").scope


def random_sample(spark, d):
    return search.random_sample(CodeIndex(spark, d).symbols.where("description is not null"), "id", 25, 7).select("id", "name")


def evaluation(spark, d):
    s = CodeIndex(spark, d).symbols.where("id % 3 = 0")
    return search.evaluation(s.select(F.col("id").alias("symbol_id"), F.when(F.col("line") % 5 != 0, F.col("line") % 5).alias("rank_b"), F.when(F.col("line") % 4 != 0, F.col("line") % 4).alias("rank_c")))


def show_numbered(spark, d):
    ix = CodeIndex(spark, d)
    s = ix.symbols.join(ix.scope.groupBy("file_id").agg(F.min("path").alias("path")), "file_id").where("snippet is not null")
    return browse.numbered_slice(s, "id", "path", "snippet", 3, 40, 10).select("id", F.md5("shown").alias("shown_md5"))


def browse_files(spark, d):
    return browse.file_list(CodeIndex(spark, d, directory="/srv/code"))


def symbol_tree(spark, d):
    return browse.symbol_tree(CodeIndex(spark, d))


def callers_callees(spark, d):
    return browse.neighbours(CodeIndex(spark, d), 10)


def symbol_detail(spark, d):
    ix = CodeIndex(spark, d)
    name = ix.symbols.groupBy("name").count().orderBy(F.desc("count"), "name").first()
    x = browse.detail(ix, name["name"] if name else "")
    return x.select("id", "name", "kind", "path", "line", "end_line", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), F.size("blocks").alias("n_blocks"))


def deps_graph(spark, d):
    return browse.file_dependencies(CodeIndex(spark, d))


def deps_adjacency(spark, d):
    ix = CodeIndex(spark, d, directory="/srv/code/quartzline")
    return browse.adjacency(browse.file_dependencies(ix), "/srv/code/quartzline")


def resolve_file(spark, d):
    return browse.resolve_files(CodeIndex(spark, d), ".go")


def line_slice(spark, d):
    return browse.line_slice(CodeIndex(spark, d).blocks.where("content is not null"), "id", "content", F.lit(2), F.lit(6))


def list_tags(spark, d):
    return browse.tag_list(CodeIndex(spark, d))


def tag_filter(spark, d):
    return browse.tagged(CodeIndex(spark, d), {"is_static": "true", "visibility": "internal"})


def summary(spark, d):
    ix = CodeIndex(spark, d)
    return browse.summary(ix, ix.raw("block_embeddings"))


def recent_files(spark, d):
    ix = CodeIndex(spark, d)
    return browse.recent_files(ix.raw("file_paths"), F.lit(1_767_225_600))


def unindexed(spark, d):
    dirs = spark.createDataFrame([("/srv/code/quartzline/",), ("/srv/code/nowhere",), ("K:\\code\\nothing",)], "dir string")
    return browse.unindexed_dirs(CodeIndex(spark, d), dirs)


def rules_table(spark):
    rows = [(0, "style", "naming", "info"), (1, "style", "size", "warning"), (2, "bugs", "leak", "error"), (3, "bugs", "race", "error")]
    return spark.createDataFrame(rows, "rule_id bigint, analyzer string, rule_name string, severity string")


def findings_table(ix):
    """Findings made from the symbols' own figures."""
    s = ix.symbols
    return s.select(F.col("id").alias("symbol_id"), F.pmod("line", F.lit(4)).cast("bigint").alias("rule_id"), F.concat(F.lit("check "), "name").alias("message"), (F.pmod("nesting_depth", F.lit(5)) / 4).alias("confidence"), (F.col("param_count") > 2).alias("stale"))


def findings_report(spark, d):
    ix = CodeIndex(spark, d)
    return browse.findings_report(ix, findings_table(ix), rules_table(spark), analyzers=("bugs", "style"), min_confidence=0.5)


def findings_json(spark, d):
    ix = CodeIndex(spark, d)
    return browse.findings_json(browse.findings_report(ix, findings_table(ix), rules_table(spark), severity="error"))


def findings_by_severity(spark, d):
    return browse.severity_counts(findings_report(spark, d))


QUERIES = {f.__name__: f for f in (vector_topk, bm25_symbols, bm25_blocks, bm25_scan, bm25_updated, hybrid_compat, hybrid_search, hybrid_filtered, hybrid_verbose, hybrid_reranked, snippet_text, scope_of_both_slashes, random_sample, evaluation, show_numbered, retrieval_metrics, browse_files, symbol_tree, callers_callees, symbol_detail, deps_graph, deps_adjacency, resolve_file, line_slice, list_tags, tag_filter, summary, recent_files, unindexed, findings_report, findings_json, findings_by_severity)}


def _terms(x):
    return f"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(prefix, docs, key, text, terms):
    n = len(terms)
    wanted = ", ".join(f"'{t}'" for t in terms)
    return f"""
{prefix}_w AS (SELECT {key} AS doc, {text} AS w FROM {docs}),
{prefix}_s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM {prefix}_w),
{prefix}_p AS (SELECT doc, len(w) AS l, t AS term, count(*) AS tf FROM {prefix}_w, unnest(w) AS u(t) WHERE t IN ({wanted}) GROUP BY ALL),
{prefix}_d AS (SELECT term, count(*) AS df FROM {prefix}_p GROUP BY term),
{prefix} AS (SELECT doc, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))) AS score
  FROM {prefix}_p JOIN {prefix}_d USING (term), {prefix}_s GROUP BY doc HAVING count(*) = {n})"""


_SYM_BM = lambda terms: _bm25("bs", "sym", "id", f"list_concat({_terms('name')}, {_terms('description')})", terms)
_BLK_BM = lambda terms: _bm25("bb", "(SELECT * FROM blocks WHERE content IS NOT NULL)", "id", _terms("content"), terms)
_VEC = """
q AS (SELECT CAST(vector AS DOUBLE[]) AS q FROM block_embeddings WHERE model = 'codevec-s' AND len(vector) = 64 ORDER BY vec_id LIMIT 1),
vs AS (SELECT content_hash, max(CASE WHEN list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[])) = 0 THEN 0 ELSE list_cosine_similarity(CAST(vector AS DOUBLE[]), q) END) AS s FROM block_embeddings, q WHERE model = 'codevec-s' AND len(vector) = 64 GROUP BY ALL),
vec AS (SELECT symbol_id AS doc, max(s) AS score FROM blocks JOIN vs USING (content_hash) GROUP BY ALL)"""
_FUSE = """
okd AS (SELECT s.id AS doc, kind, name, line, params, coalesce(end_line, line) AS end_line, p.path, coalesce(description, '') != '' AS described FROM sym s JOIN (SELECT file_id, min(path) AS path FROM paths {where} GROUP BY file_id) p USING (file_id) WHERE kind != 'heading'),
b2 AS (SELECT symbol_id AS doc, max(score) AS score FROM bb JOIN blocks ON blocks.id = bb.doc GROUP BY ALL),
legs AS ({legs}),
fused AS (SELECT doc, sum(1.0::DOUBLE / (60 + r + 1)) AS score FROM legs GROUP BY doc ORDER BY score DESC, doc LIMIT 20)
"""
_LEG = "SELECT doc, row_number() OVER (ORDER BY score DESC, doc) - 1 AS r FROM {x} SEMI JOIN okd USING (doc) WHERE score IS NOT NULL QUALIFY r < 400"
_MULT = "(CASE WHEN kind IN ('field', 'variable') THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN regexp_matches(lower(path), '/tests/|/editmode/|/playmode/|/test/|tests[.]cs|test[.]cs') THEN 0.5::DOUBLE ELSE 1 END * CASE WHEN described THEN 2.5::DOUBLE ELSE 1 END)"
_F = "f AS (SELECT id AS symbol_id, line % 4 AS rule_id, 'check ' || name AS message, (nesting_depth % 5) / 4.0::DOUBLE AS confidence, param_count > 2 AS stale FROM sym), r(rule_id, analyzer, rule_name, severity) AS (VALUES (0, 'style', 'naming', 'info'), (1, 'style', 'size', 'warning'), (2, 'bugs', 'leak', 'error'), (3, 'bugs', 'race', 'error'))"
_REPORT = f"{VIEWS}, {_F} SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_name, severity, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS severity_rank, message, confidence, s.name AS symbol_name, path, line, stale FROM f JOIN r USING (rule_id) JOIN sym s ON s.id = symbol_id JOIN paths USING (file_id) WHERE confidence > 0"
_DEPS = "deps AS (SELECT DISTINCT p.path AS caller, q.path AS callee FROM (SELECT DISTINCT caller_file, callee_file FROM edges) e JOIN paths p ON p.file_id = caller_file JOIN paths q ON q.file_id = callee_file WHERE p.path != q.path)"

SQL = {
    "vector_topk": f"{VIEWS}, {_VEC} SELECT doc, round(score, 6) AS score FROM vec ORDER BY vec.score DESC, doc LIMIT 100",
    "bm25_symbols": f"{VIEWS}, {_SYM_BM(['planner', 'the'])} SELECT doc, round(score, 9) AS score FROM bs",
    "bm25_blocks": f"{VIEWS}, {_BLK_BM(['queue', 'return'])} SELECT doc, round(score, 9) AS score FROM bb",
    "hybrid_search": f"{VIEWS}, {_VEC}, {_SYM_BM(['queue', 'return'])}, {_BLK_BM(['queue', 'return'])}, " + _FUSE.format(where="", legs=" UNION ALL ".join(f"({_LEG.format(x=x)})" for x in ("bs", "b2", "vec"))) + f" SELECT doc, kind, name, path, round(score * {_MULT}, 9) AS score FROM fused JOIN okd USING (doc)",
    "hybrid_filtered": f"{VIEWS}, {_SYM_BM(['return'])}, {_BLK_BM(['return'])}, " + _FUSE.format(where="WHERE (path ILIKE '%.py' OR path ILIKE '%.go') AND path ILIKE '%/src/%'", legs=" UNION ALL ".join(f"({_LEG.format(x=x)})" for x in ("bs", "b2"))) + f" SELECT doc, path, kind || ' ' || name || CASE WHEN coalesce(params, '') != '' THEN '(' || params || ')' ELSE '' END || '  ' || path || ':' || line || '-' || end_line AS text, round(score * {_MULT}, 9) AS score FROM fused JOIN okd USING (doc)",
    "retrieval_metrics": "WITH f AS (SELECT label, min(vec_id) AS target FROM embeddings GROUP BY label), t AS (SELECT vec_id AS other, CAST(embedding AS DOUBLE[]) AS tv FROM embeddings WHERE vec_id IN (SELECT target FROM f)), s AS (SELECT e.vec_id, target, other, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), tv), 9) AS s FROM embeddings e JOIN f USING (label), t WHERE e.vec_id != target), m AS (SELECT vec_id, s AS m FROM s WHERE other = target), k AS (SELECT vec_id, 1 + count(*) FILTER (s > m OR (s = m AND other < target)) AS rank FROM s JOIN m USING (vec_id) GROUP BY vec_id) SELECT round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS p_at_1, round(avg(1.0::DOUBLE / rank), 9) AS mrr FROM k",
    "browse_files": f"{VIEWS} SELECT DISTINCT path FROM sym JOIN paths USING (file_id) WHERE kind != 'heading' AND path ILIKE '%/srv/code/%'",
    "symbol_tree": f"{VIEWS}, s AS (SELECT *, coalesce(end_line, line) AS stop FROM sym WHERE kind != 'heading'), x AS (SELECT s.*, (SELECT count(*) FROM s c WHERE c.file_id = s.file_id AND c.kind IN ('class', 'struct', 'interface', 'enum', 'type') AND c.stop > c.line AND c.id != s.id AND c.line < s.line AND c.stop >= s.line) AS depth FROM s) SELECT path, kind, name, line, stop AS end_line, CAST(depth AS INT) AS depth, repeat('  ', CAST(depth + 1 AS INT)) || kind || ' ' || name || CASE WHEN coalesce(params, '') != '' THEN '(' || params || ')' ELSE '' END || ' (' || line || '-' || stop || ')' AS text FROM x JOIN paths USING (file_id)",
    "callers_callees": f"{VIEWS}, e AS (SELECT callee_id AS id, 'caller' AS side, caller_id AS other FROM refs UNION ALL SELECT caller_id, 'callee', callee_id FROM refs) SELECT e.id, side, other, s.name FROM e JOIN sym s ON s.id = other WHERE e.id IN (SELECT id FROM sym) QUALIFY row_number() OVER (PARTITION BY e.id, side ORDER BY other) <= 10",
    "symbol_detail": f"{VIEWS}, pick AS (SELECT name FROM sym GROUP BY name ORDER BY count(*) DESC, name LIMIT 1), e AS (SELECT callee_id AS id, 'r' AS side, caller_id AS other FROM refs UNION ALL SELECT caller_id, 'e', callee_id FROM refs), n AS (SELECT e.id, side, other, s.name FROM e JOIN sym s ON s.id = other QUALIFY row_number() OVER (PARTITION BY e.id, side ORDER BY other) <= 10) SELECT s.id, s.name, kind, path, line, coalesce(end_line, line) AS end_line, coalesce((SELECT string_agg(n.name, ',' ORDER BY other) FROM n WHERE n.id = s.id AND side = 'r'), '') AS callers, coalesce((SELECT string_agg(n.name, ',' ORDER BY other) FROM n WHERE n.id = s.id AND side = 'e'), '') AS callees, CAST((SELECT count(*) FROM blocks b WHERE b.symbol_id = s.id) AS INT) AS n_blocks FROM sym s JOIN paths USING (file_id) WHERE s.name IN (SELECT name FROM pick)",
    "deps_graph": f"{VIEWS}, {_DEPS} SELECT * FROM deps",
    "deps_adjacency": f"{VIEWS}, {_DEPS}, r AS (SELECT replace(replace(caller, '\\', '/'), '/srv/code/quartzline/', '') AS caller, replace(replace(callee, '\\', '/'), '/srv/code/quartzline/', '') AS callee FROM deps WHERE caller ILIKE '%/srv/code/quartzline/%') SELECT caller, caller || ' -> ' || string_agg(callee, ', ' ORDER BY callee) AS text FROM r GROUP BY caller",
    "resolve_file": "SELECT path FROM (SELECT DISTINCT path FROM file_paths) WHERE suffix(replace(path, '\\', '/'), '.go') ORDER BY regexp_extract(replace(path, '\\', '/'), '[^/]*$') != '.go', length(path), path LIMIT 1",
    "line_slice": f"{VIEWS}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM blocks WHERE content IS NOT NULL) SELECT id, CAST(line_no AS INT) AS line_no, line FROM l WHERE line_no BETWEEN 2 AND 6",
    "list_tags": f"{VIEWS} SELECT DISTINCT key, value FROM tags WHERE symbol_id IN (SELECT id FROM sym JOIN paths USING (file_id))",
    "tag_filter": f"{VIEWS} SELECT id, name, kind FROM sym WHERE id IN (SELECT symbol_id FROM tags WHERE key = 'is_static' AND value = 'true') AND id IN (SELECT symbol_id FROM tags WHERE key = 'visibility' AND value = 'internal')",
    "summary": f"{VIEWS}, em AS (SELECT DISTINCT symbol_id FROM blocks WHERE content_hash IN (SELECT content_hash FROM block_embeddings WHERE vector IS NOT NULL)), a AS (SELECT count(*) AS symbols, count(DISTINCT CASE WHEN id IN (SELECT symbol_id FROM em) THEN id END) AS embedded, count(*) FILTER (kind IN ('function', 'method')) AS describable, count(*) FILTER (kind IN ('function', 'method') AND description IS NOT NULL) AS described FROM sym JOIN paths USING (file_id) WHERE kind != 'heading') SELECT (SELECT count(*) FROM paths) AS files, *, CAST(floor(embedded * 100 / symbols) AS INT) AS embedded_pct, CAST(floor(described * 100 / describable) AS INT) AS described_pct FROM a",
    "recent_files": "SELECT path, max(mtime) AS mtime FROM file_paths GROUP BY path HAVING max(mtime) > 1767225600 - 604800 ORDER BY mtime DESC, path LIMIT 10",
    "unindexed": "SELECT dir FROM (VALUES ('/srv/code/quartzline'), ('/srv/code/nowhere'), ('K:/code/nothing')) t(dir) WHERE NOT EXISTS (SELECT 1 FROM file_paths WHERE starts_with(replace(path, '\\', '/'), dir || '/'))",
    "findings_report": _REPORT + " AND confidence >= 0.5",
    "findings_by_severity": f"SELECT severity, count(*) AS n FROM ({_REPORT} AND confidence >= 0.5) GROUP BY severity",
}

SQL["findings_json"] = f"SELECT json_object('rule_name', rule_name, 'severity', severity, 'message', message, 'confidence', confidence, 'symbol_name', symbol_name, 'file_path', path, 'line', line)::VARCHAR AS json FROM ({_REPORT}) WHERE severity = 'error'"
_HITS = SQL["hybrid_filtered"].rsplit(" SELECT doc, path, kind", 1)[0].replace("LIMIT 20", "LIMIT {n}").replace("QUALIFY r < 400", "QUALIFY r < {k}")
_HIT = f"hit AS (SELECT doc, okd.*, score * {_MULT} AS final FROM fused JOIN okd USING (doc)), placed AS (SELECT *, row_number() OVER (ORDER BY final DESC, doc) AS place FROM hit)"
_SHOWN = r"""shown AS (SELECT p.doc, CAST(place AS INT) AS place, '[' || place || '] ' || p.kind || ' ' || p.name || CASE WHEN coalesce(p.params, '') != '' THEN '(' || p.params || ')' ELSE '' END || '  ' || p.path || ':' || p.line || '-' || p.end_line || '  score:' || printf('%.3f', final) || CASE WHEN coalesce(s.description, '') != '' THEN '  ' || s.description ELSE '' END
  || CASE WHEN coalesce(b.content, '') != '' THEN chr(10) || '  ' || regexp_replace(regexp_replace(b.content, '\r?\n$', ''), '\r?\n', chr(10) || '  ', 'g') ELSE '' END {refs} AS text
  FROM placed p JOIN sym s ON s.id = p.doc LEFT JOIN (SELECT symbol_id, arg_min(content, id) AS content FROM blocks WHERE block_index = 0 GROUP BY symbol_id) b ON b.symbol_id = p.doc {join})""".replace("\\\\", "\\")
_NEAR = "near AS (SELECT id, string_agg(CASE side WHEN 0 THEN 'calls: ' ELSE 'calledby: ' END || name || ' (' || at_path || ')', chr(10) ORDER BY side, other) AS near FROM (SELECT e.id, side, other, s.name, h.path AS at_path FROM (SELECT caller_id AS id, 0 AS side, callee_id AS other FROM refs UNION ALL SELECT callee_id, 1, caller_id FROM refs) e JOIN sym s ON s.id = other LEFT JOIN (SELECT file_id, min(path) AS path FROM paths GROUP BY file_id) h ON h.file_id = s.file_id QUALIFY row_number() OVER (PARTITION BY e.id, side ORDER BY other) <= 10) WHERE at_path IS NOT NULL GROUP BY id)"
_hits = lambda n, where=None: (_HITS if where is None else _HITS.replace("WHERE (path ILIKE '%.py' OR path ILIKE '%.go') AND path ILIKE '%/src/%'", where)).replace("{n}", str(n)).replace("{k}", str(20 * n))
SQL |= {
    "hybrid_verbose": _hits(20) + f", {_HIT}, {_NEAR}, " + _SHOWN.replace("{refs}", "|| CASE WHEN near IS NOT NULL THEN chr(10) || near ELSE '' END").replace("{join}", "LEFT JOIN near ON near.id = p.doc") + " SELECT * FROM shown",
    "snippet_text": _hits(10, "WHERE path ILIKE '%/src/%'") + f", {_HIT}, " + _SHOWN.replace("{refs}", "").replace("{join}", "") + " SELECT md5(string_agg(text, chr(10) ORDER BY place)) AS text_md5 FROM shown",
    "hybrid_reranked": _hits(20) + f", {_HIT}, o AS (SELECT *, row_number() OVER (ORDER BY name, doc) AS k FROM placed) SELECT doc, CAST(row_number() OVER (ORDER BY CASE WHEN k <= 5 THEN k ELSE 1000 + place END) - 1 AS INT) AS position FROM o",
    "scope_of_both_slashes": f"{VIEWS} SELECT path, file_id FROM paths WHERE {UNDER('K:/code')}",
    "random_sample": f"{VIEWS} SELECT id, name FROM sym WHERE description IS NOT NULL ORDER BY md5('7:' || id), id LIMIT 25",
    "evaluation": f"{VIEWS}, s AS (SELECT id, nullif(line % 5, 0) AS b, nullif(line % 4, 0) AS c FROM sym WHERE id % 3 = 0), a AS (SELECT count(*) AS n, '[' || string_agg(id::VARCHAR, ',' ORDER BY id) || ']' AS ids, round(avg(CASE WHEN b = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS b1, round(avg(coalesce(1.0::DOUBLE / b, 0)), 4) AS b2, round(avg(CASE WHEN c = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS c1, round(avg(coalesce(1.0::DOUBLE / c, 0)), 4) AS c2 FROM s) SELECT '{{\"n_samples\":' || n || ',\"symbol_ids\":' || ids || ',\"method_B\":{{\"p_at_1\":' || b1 || ',\"mrr\":' || b2 || '}},\"method_C\":{{\"p_at_1\":' || c1 || ',\"mrr\":' || c2 || '}}}}' AS json FROM a",
    "show_numbered": f"{VIEWS}, h AS (SELECT file_id, min(path) AS path FROM paths GROUP BY file_id), t AS (SELECT id, path, string_split_regex(regexp_replace(snippet, '\\r?\\n$', ''), '\\r?\\n') AS l, snippet FROM sym JOIN h USING (file_id) WHERE snippet IS NOT NULL), n AS (SELECT *, CASE WHEN snippet = '' THEN 0 ELSE len(l) END AS total FROM t), w AS (SELECT *, CASE WHEN least(40, total) < 3 THEN total ELSE least(40, total) END AS wanted FROM n), z AS (SELECT *, least(wanted, 12) AS last FROM w), b AS (SELECT *, [lpad(i::VARCHAR, CAST(length(last::VARCHAR) AS INT), ' ') || '  ' || l[i] FOR i IN range(3, last + 1)] AS body FROM z) SELECT id, md5(CASE WHEN total = 0 THEN '' ELSE path || ' (lines 3-' || last || '/' || total || ')' || CASE WHEN wanted > last THEN ' [truncated; ' || (wanted - last) || ' more lines omitted]' ELSE '' END || chr(10) || array_to_string(body, chr(10)) END) AS shown_md5 FROM b",
}

_RULES = "SELECT doc, max(r) AS r FROM (SELECT x.doc, row_number() OVER (ORDER BY score DESC, x.doc, p.path) - 1 AS r FROM {x} x JOIN okd USING (doc) JOIN sym s ON s.id = x.doc JOIN paths p ON p.file_id = s.file_id WHERE score IS NOT NULL QUALIFY r < 400) GROUP BY doc"
SQL |= {
    "bm25_scan": SQL["bm25_blocks"],
    "bm25_updated": f"{VIEWS}, " + _bm25("bb", "(SELECT * FROM blocks WHERE content IS NOT NULL AND id % 7 != 0)", "id", _terms("content"), ["queue", "return"]) + " SELECT doc, round(score, 9) AS score FROM bb",
    "hybrid_compat": f"{VIEWS}, {_VEC.replace('vec AS (SELECT symbol_id AS doc, max(s) AS score FROM blocks JOIN vs USING (content_hash) GROUP BY ALL)', 'vec AS (SELECT symbol_id AS doc, s AS score FROM blocks JOIN vs USING (content_hash))')}, {_SYM_BM(['queue', 'return'])}, {_BLK_BM(['queue', 'return'])}, " + _FUSE.format(where="", legs=" UNION ALL ".join(f"({_RULES.format(x=x)})" for x in ("bs", "b2", "vec"))).replace("b2 AS (SELECT symbol_id AS doc, max(score) AS score FROM bb JOIN blocks ON blocks.id = bb.doc GROUP BY ALL)", "b2 AS (SELECT symbol_id AS doc, score FROM bb JOIN blocks ON blocks.id = bb.doc)") + f" SELECT doc, round(any_value(score) * product({_MULT.replace('path', 'p.path')}), 9) AS score FROM fused JOIN (SELECT doc, kind, described FROM okd) USING (doc) JOIN (SELECT id, file_id FROM sym) s ON s.id = doc JOIN paths p ON p.file_id = s.file_id GROUP BY doc",
}
