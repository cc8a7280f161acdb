"""Queries of the lint rules, clones and clusters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoscope.operators import clones, lint
from lithoscope.plans.index import NESTED, UNDER, VIEWS, CodeIndex, nested

#: Thresholds of the queries: low enough to give rows on the test tables.
T = {"long_function": 40, "too_many_params": 2, "deep_nesting": 2, "god_file": 5, "high_fan_out": 8, "unused_symbol": 0, "static_symbol": 0, "wide_module": 10, "wide_package": 5, "dep_spread": 100, "fat_class": 0, "split_class": 1, "mixed_abstraction": 1, "dip_violation": 3}


def _rule(name):
    index = nested if name in ("fat_class", "split_class") else CodeIndex
    return lambda spark, d: lint.RULES[name].check(index(spark, d), T[name])


def lint_union(spark, d):
    names = ("long_function", "too_many_params", "deep_nesting", "god_file", "high_fan_out", "wide_module", "wide_package", "dip_violation")
    off = {n: None for n in lint.RULES}
    return lint.lint(CodeIndex(spark, d, directory="/srv/code", excludes=("*/old/*",)), off | {n: T[n] for n in names}, min_score=1.5)


def duplicate_symbol(spark, d):
    return lint.duplicate_symbol(CodeIndex(spark, d), 3)


def lint_text(spark, d):
    return lint.report_text(lint.high_fan_out(CodeIndex(spark, d), 8))


def lint_totals(spark, d):
    ix = CodeIndex(spark, d)
    return lint.totals_text(lint.long_function(ix, 40), ix.symbols.join(ix.scope, "file_id"), lint.confusing(ix, _judged(ix)))


def _judged(ix):
    """Tags as an analyzer leaves them: deep functions are confusing, some with a reason."""
    s = ix.symbols.where("nesting_depth >= 4")
    said = s.select(F.col("id").alias("symbol_id"), F.lit("confusing").alias("key"), F.lit("true").alias("value"))
    return said.unionByName(s.where("line % 2 = 0").select(F.col("id").alias("symbol_id"), F.lit("confusing_reason").alias("key"), F.concat(F.lit("depth "), F.col("nesting_depth").cast("string")).alias("value")))


def confusing_symbols(spark, d):
    ix = CodeIndex(spark, d)
    return lint.confusing(ix, _judged(ix))


def lint_suppressed(spark, d):
    s = spark.createDataFrame([("/srv/code/quartzline", "*"), ("/srv/code/hazelnut/", "high_fan_out"), ("/srv/code/jaybird/src", "dip_violation")], "dir string, rule string")
    ix = CodeIndex(spark, d)
    return lint.suppress(lint.high_fan_out(ix, 8).unionByName(lint.long_function(ix, 40)), s)


def lint_density(spark, d):
    ix = CodeIndex(spark, d)
    return lint.density(lint.long_function(ix, 40), ix.symbols.join(ix.scope, "file_id"))


def exact_clone_groups(spark, d):
    return clones.exact_clones(CodeIndex(spark, d))


def fingerprints(spark, d):
    return clones.fingerprints(CodeIndex(spark, d)).select("id", "normhash", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("simhash"))


def near_clone_pairs(spark, d):
    f = clones.fingerprints(CodeIndex(spark, d)).select(F.col("simhash").alias("h"))
    return clones.near_pairs(f, 3)


def near_clone_groups(spark, d):
    return clones.near_clones(CodeIndex(spark, d), 3).select("id", "path", "line", "name", F.col("distance").cast("int").alias("distance"))


def semantic_clusters(spark, d):
    ix = CodeIndex(spark, d)
    return clones.semantic_clusters(ix, ix.raw("block_embeddings"), 0.1).select("id", "path", "name", "line", F.round("nearest", 6).alias("nearest"), F.col("cluster"))


_HOME = "home AS (SELECT file_id, min(path) AS path FROM paths GROUP BY file_id),"
_CODE = "kind IN ('function', 'method')"


def _simple(name, value, text, cond="true"):
    t = T[name]
    return f"{VIEWS} SELECT path, CAST(line AS INT) AS line, '{name}' AS rule, {text} AS display, CAST({value} AS DOUBLE) / {max(t, 1)} AS score FROM sym JOIN paths USING (file_id) WHERE {_CODE} AND {cond} AND {value} > {t}"


_CALLEES = "callees AS (SELECT DISTINCT p.path, q.path AS callee_path, CASE WHEN replace(q.path, '\\', '/') LIKE '%/%' THEN regexp_replace(replace(q.path, '\\', '/'), '/[^/]*$', '') ELSE '' END AS dir FROM file_edges e JOIN paths p ON p.file_id = e.caller_file JOIN paths q ON q.file_id = e.callee_file)"
_LONG = _simple("long_function", "(end_line - line)", "name || ' (' || (end_line - line) || ' lines)'", "end_line IS NOT NULL")
_FAN = f"{VIEWS}, {_HOME} n AS (SELECT s.id, s.name, s.line, s.file_id, (SELECT count(*) FROM refs r WHERE r.caller_id = s.id) + (SELECT count(*) FROM ext e WHERE e.caller_id = s.id) AS v FROM sym s WHERE {_CODE}) SELECT path, line, 'high_fan_out' AS rule, name || ' (' || v || ' callees)' AS display, v / 8.0::DOUBLE AS score FROM n JOIN home USING (file_id) WHERE v > 8"
_MODULE = "CASE WHEN replace({p}, '\\', '/') LIKE '%.cs' THEN coalesce({n}, replace({p}, '\\', '/')) WHEN replace({p}, '\\', '/') LIKE '%.go' AND replace({p}, '\\', '/') LIKE '%/%' THEN regexp_replace(replace({p}, '\\', '/'), '/[^/]*$', '') ELSE replace({p}, '\\', '/') END"
_INSIDE = "inside AS (SELECT c.id AS class_id, c.name AS class_name, c.line AS class_line, c.file_id, m.id AS member_id, m.kind FROM sym c JOIN sym m ON m.file_id = c.file_id AND m.line > c.line AND m.end_line <= c.end_line WHERE c.kind IN ({k}) AND c.end_line IS NOT NULL AND m.kind IN ({m}))"

SQL = {
    "long_function": _LONG,
    "too_many_params": _simple("too_many_params", "param_count", "name || ' (' || param_count || ' params)'"),
    "deep_nesting": _simple("deep_nesting", "nesting_depth", "name || ' (depth ' || nesting_depth || ')'"),
    "god_file": f"{VIEWS} SELECT min(path) AS path, 1 AS line, 'god_file' AS rule, count(*) || ' symbols' AS display, count(*) / 5.0::DOUBLE AS score FROM sym JOIN paths USING (file_id) WHERE kind != 'heading' GROUP BY file_id HAVING count(*) > 5",
    "high_fan_out": _FAN,
    "unused_symbol": f"{VIEWS} SELECT path, line, 'unused_symbol' AS rule, name AS display, 1.0::DOUBLE AS score FROM sym JOIN paths USING (file_id) WHERE {_CODE} AND NOT EXISTS (SELECT 1 FROM refs WHERE callee_id = sym.id)",
    "static_symbol": f"{VIEWS} SELECT path, line, 'static_symbol' AS rule, name || ' (' || kind || ')' AS display, 1.0::DOUBLE AS score FROM sym JOIN paths USING (file_id) WHERE id IN (SELECT symbol_id FROM tags WHERE key = 'is_static')",
    "wide_module": f"{VIEWS}, {_HOME} n AS (SELECT caller_file AS file_id, count(*) AS v FROM file_edges GROUP BY ALL) SELECT path, 1 AS line, 'wide_module' AS rule, v || ' file dependencies' AS display, v / 10.0::DOUBLE AS score FROM n JOIN home USING (file_id) WHERE v > 10",
    "wide_package": f"{VIEWS}, {_CALLEES}, n AS (SELECT path, count(DISTINCT dir) AS v FROM callees GROUP BY path) SELECT path, 1 AS line, 'wide_package' AS rule, v || ' packages' AS display, v / 5.0::DOUBLE AS score FROM n WHERE v > 5",
    "dep_spread": f"{VIEWS}, {_CALLEES}, d AS (SELECT path, count(DISTINCT callee_path) AS deps FROM callees GROUP BY path), s AS (SELECT path, count(*) AS total FROM sym JOIN paths USING (file_id) GROUP BY path), n AS (SELECT path, deps, greatest(coalesce(total, 1), 1) AS total, deps * 100 // greatest(coalesce(total, 1), 1) AS v FROM d LEFT JOIN s USING (path)) SELECT path, 1 AS line, 'dep_spread' AS rule, v || '% spread (' || deps || ' deps, ' || total || ' symbols)' AS display, v / 100.0::DOUBLE AS score FROM n WHERE v > 100",
    "fat_class": f"{NESTED}, {_HOME} " + _INSIDE.format(k="'class','struct','interface'", m="'method'") + " SELECT path, class_line AS line, 'fat_class' AS rule, class_name || ' (' || count(*) || ' methods)' AS display, count(*) / 1.0::DOUBLE AS score FROM inside JOIN home USING (file_id) GROUP BY class_id, class_name, class_line, path HAVING count(*) > 0",
    "mixed_abstraction": f"{VIEWS}, {_HOME} inbound AS (SELECT callee_file, count(*) AS n FROM file_edges GROUP BY ALL), c AS (SELECT DISTINCT caller_id, callee_file FROM edges WHERE caller_file != callee_file), n AS (SELECT caller_id AS id, count(*) FILTER (n >= 5) AS high, count(*) FILTER (n <= 1) AS low FROM c JOIN inbound USING (callee_file) GROUP BY ALL) SELECT path, line, 'mixed_abstraction' AS rule, name || ' mixes ' || high || ' high-level + ' || low || ' low-level deps' AS display, (high + low) / 2.0::DOUBLE AS score FROM n JOIN sym USING (id) JOIN home USING (file_id) WHERE {_CODE} AND high >= 1 AND low >= 1",
    "dip_violation": f"{VIEWS}, ns AS (SELECT file_id, min(value) AS ns FROM tags JOIN sym ON id = symbol_id WHERE key = 'namespace' GROUP BY file_id), places AS (SELECT p.file_id, path, "
    + _MODULE.format(p="path", n="ns")
    + " AS module FROM paths p LEFT JOIN ns USING (file_id)), e AS (SELECT a.module AS u, b.module AS v, min(a.path) AS path FROM (SELECT DISTINCT caller_file, callee_file FROM edges WHERE caller_ext = callee_ext) x JOIN places a ON a.file_id = caller_file JOIN places b ON b.file_id = callee_file WHERE a.path != b.path AND a.module != b.module GROUP BY ALL), f AS (SELECT u, min(path) AS path FROM e GROUP BY u), i AS (SELECT v AS m, count(*) AS n FROM e GROUP BY v) SELECT f.path, 1 AS line, 'dip_hint' AS rule, 'may depend on lower-level module ' || e.v || ' (' || i.n || ' dependents)' AS display, i.n / 3.0::DOUBLE AS score FROM e JOIN f USING (u) JOIN i ON i.m = e.v LEFT JOIN i o ON o.m = e.u WHERE i.n >= 3 AND coalesce(o.n, 0) < i.n",
    "lint_suppressed": f"WITH all_rows AS (({_LONG}) UNION ALL ({_FAN})) SELECT * FROM all_rows WHERE NOT starts_with(replace(path, '\\', '/'), '/srv/code/quartzline/') AND NOT (starts_with(replace(path, '\\', '/'), '/srv/code/hazelnut/') AND rule = 'high_fan_out')",
    "lint_density": f"WITH total AS (SELECT count(*) AS total FROM ({_LONG})), s AS ({VIEWS} SELECT count(*) AS symbols FROM sym JOIN paths USING (file_id)) SELECT total, symbols, round(total * 100 / symbols, 2) AS per100 FROM total, s",
    "exact_clone_groups": f"{VIEWS}, f AS (SELECT file_id, name, line, sha256(trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g'))) AS hash FROM sym WHERE {_CODE} AND snippet IS NOT NULL), g AS (SELECT hash, path, line, name, count(*) OVER (PARTITION BY hash) AS n, row_number() OVER (PARTITION BY hash ORDER BY path, line, name) AS r FROM f JOIN paths USING (file_id) WHERE hash IN (SELECT hash FROM f JOIN paths USING (file_id) GROUP BY hash HAVING count(DISTINCT file_id) > 1)) SELECT hash, path, line, name, n FROM g WHERE r = 1",
}
_SIM = f"""{VIEWS}, t AS (SELECT id, snippet AS s FROM sym WHERE {_CODE} AND snippet IS NOT NULL),
gram AS (SELECT id, ('0x' || right(md5(substr(s, CAST(i AS INT), 4)), 16))::UBIGINT AS h FROM t, unnest(range(1, length(s) - 2)) AS u(i) WHERE length(s) >= 4),
vote AS (SELECT id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM gram, range(0, 64) AS r(b) GROUP BY ALL),
sim AS (SELECT t.id, coalesce((SELECT bit_or(1::UBIGINT << b) FROM vote WHERE vote.id = t.id AND v > 0), 0)::UBIGINT AS h FROM t)
"""
SQL["fingerprints"] = _SIM + "SELECT t.id, sha256(trim(regexp_replace(lower(s), '\\s+', ' ', 'g'))) AS normhash, lower(lpad(to_hex(h), 16, '0')) AS simhash FROM t JOIN sim USING (id)"
SQL["near_clone_pairs"] = _SIM + ", d AS (SELECT DISTINCT h, CASE WHEN h >= 9223372036854775808 THEN CAST(h::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(h AS BIGINT) END AS s FROM sim) SELECT a.s AS a, b.s AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM d a JOIN d b ON a.s < b.s WHERE bit_count(xor(a.h, b.h)) <= 3"

# the smallest node that each node reaches, over edges (u, v); `value` links equal hashes of different paths
_REACH = "both_ways AS (SELECT u AS a, v AS b FROM links UNION SELECT v, u FROM links), reach AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, b.b FROM reach r JOIN both_ways b ON b.a = r.seen), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"
_recursive = lambda sql: sql.replace("WITH sym AS", "WITH RECURSIVE sym AS", 1)
_NEAR = _SIM + """, sg AS (SELECT id, CASE WHEN h >= 9223372036854775808 THEN CAST(h::HUGEINT - 18446744073709551616 AS BIGINT) ELSE CAST(h AS BIGINT) END AS s, h FROM sim),
place AS (SELECT s.id, s.name, s.line, s.file_id, p.path, sg.s, sg.h FROM sg JOIN sym s USING (id) JOIN paths p USING (file_id)),
spread AS (SELECT DISTINCT s, h, path FROM place),
pair AS (SELECT a.s AS u, b.s AS v, CAST(bit_count(xor(a.h, b.h)) AS INT) AS distance FROM spread a JOIN spread b ON a.s <= b.s AND a.path != b.path AND bit_count(xor(a.h, b.h)) <= 3 GROUP BY ALL),
links AS (SELECT u, v FROM pair), """ + _REACH + """, least AS (SELECT component, min(distance) AS distance FROM pair JOIN comp ON comp.node = pair.u GROUP BY ALL),
near AS (SELECT id, min(path) AS path, any_value(line) AS line, any_value(name) AS name, component, any_value(distance) AS distance FROM place JOIN comp ON comp.node = place.s JOIN least USING (component) GROUP BY id, component)
"""
SQL["near_clone_groups"] = _recursive(_NEAR + "SELECT id, path, line, name, distance FROM near")
SQL["duplicate_symbol"] = _recursive(_NEAR + f", f AS (SELECT file_id, name, line, sha256(trim(regexp_replace(lower(snippet), '\\s+', ' ', 'g'))) AS hash FROM sym WHERE {_CODE} AND snippet IS NOT NULL), x AS (SELECT hash, count(*) AS n, count(DISTINCT file_id) AS files, min((path, line, name)) AS pl FROM f JOIN paths USING (file_id) GROUP BY hash), g AS (SELECT count(*) AS n, min(distance) AS d, min((path, line)) AS pl FROM near GROUP BY component) SELECT pl[1] AS path, CAST(pl[2] AS INT) AS line, 'exact_clone' AS rule, 'exact clone: ' || pl[3] || ' (' || n || ' copies, hash ' || left(hash, 8) || ')' AS display, 2.0::DOUBLE AS score FROM x WHERE files > 1 UNION ALL SELECT pl[1], CAST(pl[2] AS INT), 'near_clone', 'near-clone group: ' || n || ' symbols, closest distance ' || d, 1.0::DOUBLE + (3 - d) / 3.0::DOUBLE FROM g")
SQL["semantic_clusters"] = _recursive(f"""{VIEWS}, e AS (SELECT content_hash, model, any_value(CAST(vector AS DOUBLE[])) AS v FROM block_embeddings WHERE vector IS NOT NULL AND content_hash IS NOT NULL GROUP BY ALL),
m AS (SELECT model FROM e GROUP BY model ORDER BY count(*) DESC, model LIMIT 1), n AS (SELECT mode(len(v)) AS n FROM e WHERE model IN (FROM m)),
w AS (SELECT content_hash, v FROM e, n WHERE model IN (FROM m) AND len(v) = n.n AND list_inner_product(v, v) > 0),
h AS (SELECT file_id, min(path) AS path FROM paths WHERE path NOT ILIKE '%test%' GROUP BY file_id),
c AS (SELECT DISTINCT s.id, h.path, s.name, s.line, w.content_hash AS ch FROM sym s JOIN h USING (file_id) JOIN blocks b ON b.symbol_id = s.id AND block_index = 0 JOIN w ON w.content_hash = b.content_hash WHERE {_CODE}),
near AS (SELECT a.id AS u, b.id AS v, 1 - list_cosine_similarity(x.v, y.v) AS d FROM c a JOIN w x ON x.content_hash = a.ch JOIN c b ON a.id != b.id JOIN w y ON y.content_hash = b.ch WHERE 1 - list_cosine_similarity(x.v, y.v) < 0.1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(d, 12), b.id) <= 20),
links AS (SELECT u, v FROM near), {_REACH}, least AS (SELECT id, min(d) AS d FROM (SELECT u AS id, d FROM near UNION ALL SELECT v, d FROM near) GROUP BY id)
SELECT c.id, path, name, line, component AS cluster, round(d, 6) AS nearest FROM c JOIN comp ON comp.node = c.id JOIN least ON least.id = c.id""")
SQL["split_class"] = _recursive(f"""{NESTED}, """ + _INSIDE.format(k="'class','struct'", m="'function','method'") + """, mem AS (SELECT DISTINCT class_id, class_name, file_id, member_id FROM inside),
links AS (SELECT DISTINCT (a.class_id, a.member_id) AS u, (b.class_id, b.member_id) AS v FROM refs r JOIN mem a ON a.member_id = r.caller_id JOIN mem b ON b.member_id = r.callee_id AND b.class_id = a.class_id WHERE a.member_id != b.member_id), """ + _REACH + """,
g AS (SELECT class_id, class_name, file_id, count(*) AS methods, count(DISTINCT coalesce(component, (class_id, member_id))) AS v FROM mem LEFT JOIN comp ON comp.node = (class_id, member_id) GROUP BY ALL)
SELECT path, 1 AS line, 'split_class' AS rule, class_name || ' (' || v || ' disconnected method groups)' AS display, CAST(v AS DOUBLE) / 1 AS score FROM g JOIN paths USING (file_id) WHERE methods >= 2 AND v >= 1""")
# the union: the rules' own SQL over the paths of the scope
_UNION = ("long_function", "too_many_params", "deep_nesting", "god_file", "high_fan_out", "wide_module", "wide_package", "dip_violation")


def _within(sql):
    """A rule's SQL with its reported paths from the scope: the callees' paths stay all paths."""
    inside = f"scope AS (SELECT path, file_id FROM paths WHERE {UNDER('/srv/code')} AND path NOT ILIKE '%/old/%'),"
    head, tail = sql[: len(VIEWS)], sql[len(VIEWS) :]
    tail = tail.replace("FROM paths GROUP BY file_id", "FROM scope GROUP BY file_id").replace("JOIN paths USING", "JOIN scope USING").replace("JOIN paths p ON p.file_id = e.caller_file", "JOIN scope p ON p.file_id = e.caller_file").replace("FROM paths p LEFT JOIN ns", "FROM scope p LEFT JOIN ns")
    tail = tail.lstrip()
    return head + ", " + inside + " " + tail[1:] if tail.startswith(",") else head + ", " + inside.rstrip(",") + " " + tail


SQL["lint_union"] = " UNION ALL ".join(f"(SELECT path, line, rule, display, CAST(score AS DOUBLE) AS score FROM ({_within(SQL[n])}) WHERE score >= 1.5)" for n in _UNION)
_JUDGED = "judged AS (SELECT path, line, name, CASE WHEN line % 2 = 0 THEN 'depth ' || nesting_depth ELSE '' END AS reason FROM sym JOIN paths USING (file_id) WHERE kind IN ('function', 'method') AND nesting_depth >= 4)"
SQL["confusing_symbols"] = f"{VIEWS}, {_JUDGED} SELECT * FROM judged"
SQL["lint_text"] = f"SELECT '  ' || rpad(loc, greatest(60, CAST(length(loc) AS INT)), ' ') || ' ' || rpad(rule, 22, ' ') || '  ' || printf('%5.1f', score) || 'x  ' || display AS text FROM (SELECT *, path || ':' || line AS loc FROM ({_FAN}))"
SQL["lint_totals"] = f"WITH total AS (SELECT count(*) AS total FROM ({_LONG})), s AS ({VIEWS} SELECT count(*) AS symbols FROM sym JOIN paths USING (file_id)), c AS ({VIEWS}, {_JUDGED} SELECT count(*) AS n FROM judged) SELECT '  (all)  symbols=' || symbols || ' violations=' || total || ' per100s=' || round(total * 100 / symbols, 2) || ' confusing=' || n AS text FROM total, s, c"

QUERIES = {n: _rule(n) for n in T} | {f.__name__: f for f in (lint_union, lint_suppressed, lint_density, lint_text, lint_totals, confusing_symbols, duplicate_symbol, exact_clone_groups, fingerprints, near_clone_pairs, near_clone_groups, semantic_clusters)}
