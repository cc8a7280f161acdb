"""Queries of problem 2 and their SQL."""

from pyspark.sql import functions as F

from lithoscope.operators.orphans import orphan_report
from lithoscope.session import table


def p2_found(spark, d):
    return orphan_report(*(table(spark, d, t) for t in ("symbol_refs", "external_refs", "file_paths", "symbols", "files", "known_externals")))


def p2_report(spark, d):
    return p2_found(spark, d).groupBy("src_table", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))


_FOUND = """
WITH refs AS (
  SELECT 'symbol_refs' AS src_table, recorded_at AS ts, CAST(caller_id AS VARCHAR) AS src_key, CAST(callee_id AS VARCHAR) AS ref_key FROM symbol_refs
  UNION ALL SELECT 'external_refs', recorded_at, CAST(caller_id AS VARCHAR), regexp_replace(callee_name, '^\\s+|\\s+$', '', 'g') FROM external_refs
  UNION ALL SELECT 'file_paths', seen_at, path, CAST(file_id AS VARCHAR) FROM file_paths),
have AS (
  SELECT 'symbol_refs' AS src_table, CAST(id AS VARCHAR) AS ref_key, min(indexed_at) AS since FROM symbols WHERE removed_at IS NULL GROUP BY ALL
  UNION ALL SELECT 'external_refs', name, min(indexed_at) FROM symbols WHERE removed_at IS NULL GROUP BY ALL
  UNION ALL SELECT 'file_paths', CAST(file_id AS VARCHAR), min(indexed_at) FROM files WHERE removed_at IS NULL GROUP BY ALL),
found AS (
  SELECT DISTINCT r.src_table, strftime(ts, '%Y-%m') AS period, src_key, r.ref_key
  FROM refs r LEFT JOIN have h ON r.src_table = h.src_table AND r.ref_key = h.ref_key
  WHERE r.ref_key IS NOT NULL AND r.ref_key != '' AND (since IS NULL OR ts IS NULL OR ts < since)
    AND NOT (r.src_table = 'external_refs' AND r.ref_key IN (SELECT callee_name FROM known_externals)))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _FOUND + "SELECT * FROM found",
    "p2_report": _FOUND + "SELECT src_table, period, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY ALL",
}
