"""The code index as DataFrames, and the same views in SQL.

Tables may hold exact repeats and removed rows; the views hold each live row once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from lithoscope.functions.text import dirname, like, under
from lithoscope.session import need, table


@dataclass
class CodeIndex:
    spark: SparkSession
    folder: str
    directory: str = ""
    excludes: tuple[str, ...] = ()

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def symbols(self) -> DataFrame:
        cols = ("id", "file_id", "name", "kind", "line", "end_line", "content_hash", "params", "nesting_depth", "param_count", "description", "ext", "snippet")
        return need(self.raw("symbols").where("removed_at is null"), *cols).dropDuplicates(["id"])

    @cached_property
    def files(self) -> DataFrame:
        return need(self.raw("files").where("removed_at is null"), "file_id", "hash", "size").distinct()

    @cached_property
    def paths(self) -> DataFrame:
        return need(self.raw("file_paths"), "path", "file_id").distinct()

    @cached_property
    def scope(self) -> DataFrame:
        """`path, file_id` in the directory, without the excluded globs."""
        out = self.paths
        if self.directory:
            out = out.where(under("path", self.directory))
        for e in self.excludes:
            out = out.where(~like("path", e.replace("\\", "/").replace("*", "%").replace("?", "_")))
        return out

    @cached_property
    def blocks(self) -> DataFrame:
        return need(self.raw("code_blocks"), "id", "symbol_id", "block_index", "content", "content_hash", "start_line", "end_line", "description").dropDuplicates(["id"])

    @cached_property
    def refs(self) -> DataFrame:
        return need(self.raw("symbol_refs"), "caller_id", "callee_id").distinct()

    @cached_property
    def external(self) -> DataFrame:
        return need(self.raw("external_refs"), "caller_id", "callee_name").where("callee_name is not null").distinct()

    @cached_property
    def tags(self) -> DataFrame:
        """`symbol_id, key, value`: static, visibility and namespace, read off name and snippet."""
        s = self.symbols
        pairs = F.map_filter(
            F.create_map(
                F.lit("is_static"), F.when(F.col("snippet").rlike(r"^\s*(?:[a-z]+\s+)*static\b"), "true"),
                F.lit("visibility"), F.nullif(F.regexp_extract("snippet", r"^\s*(public|private|protected|internal|export)\b", 1), F.lit("")),
                F.lit("namespace"), F.nullif(F.regexp_extract("name", r"^(.+)\.[^.]+$", 1), F.lit("")),
            ),
            lambda k, v: v.isNotNull(),
        )
        return s.select(F.col("id").alias("symbol_id"), F.explode(pairs).alias("key", "value"))

    @cached_property
    def edges(self) -> DataFrame:
        """Live call edges with both ends' files: `caller_id, callee_id, caller_file, callee_file, caller_ext, callee_ext`."""
        a = self.symbols.select(F.col("id").alias("caller_id"), F.col("file_id").alias("caller_file"), F.col("ext").alias("caller_ext"))
        b = self.symbols.select(F.col("id").alias("callee_id"), F.col("file_id").alias("callee_file"), F.col("ext").alias("callee_ext"))
        return self.refs.join(a, "caller_id").join(b, "callee_id")

    @cached_property
    def file_edges(self) -> DataFrame:
        """Distinct pairs of content files of which one calls into the other."""
        return self.edges.where("caller_file != callee_file").select("caller_file", "callee_file").distinct()

    @cached_property
    def file_dirs(self) -> DataFrame:
        return self.paths.select("file_id", F.col("path").alias("callee_path"), dirname("path").alias("dir"))


def nested(spark: SparkSession, folder: str, reach: int = 400) -> CodeIndex:
    """An index whose containers hold the `reach` lines behind their beginning, so that they have members in the test tables."""
    ix = CodeIndex(spark, folder)
    wide = F.when(F.col("kind").isin("class", "struct", "interface"), F.col("line") + reach).otherwise(F.col("end_line"))
    ix.symbols = ix.symbols.withColumn("end_line", wide)
    return ix


#: SQL of the views above.
VIEWS = r"""
WITH sym AS (SELECT DISTINCT id, file_id, name, kind, line, end_line, content_hash, params, nesting_depth, param_count, description, ext, snippet FROM symbols WHERE removed_at IS NULL),
paths AS (SELECT DISTINCT path, file_id FROM file_paths),
live_files AS (SELECT DISTINCT file_id, hash, size FROM files WHERE removed_at IS NULL),
blocks AS (SELECT DISTINCT id, symbol_id, block_index, content, content_hash, start_line, end_line, description FROM code_blocks),
refs AS (SELECT DISTINCT caller_id, callee_id FROM symbol_refs),
ext AS (SELECT DISTINCT caller_id, callee_name FROM external_refs WHERE callee_name IS NOT NULL),
tags AS (
  SELECT id AS symbol_id, 'is_static' AS key, 'true' AS value FROM sym WHERE regexp_matches(snippet, '^\s*(?:[a-z]+\s+)*static\b')
  UNION ALL SELECT id, 'visibility', regexp_extract(snippet, '^\s*(public|private|protected|internal|export)\b', 1) FROM sym WHERE regexp_matches(snippet, '^\s*(public|private|protected|internal|export)\b')
  UNION ALL SELECT id, 'namespace', regexp_extract(name, '^(.+)\.[^.]+$', 1) FROM sym WHERE regexp_matches(name, '^(.+)\.[^.]+$')),
edges AS (SELECT r.caller_id, r.callee_id, a.file_id AS caller_file, b.file_id AS callee_file, a.ext AS caller_ext, b.ext AS callee_ext FROM refs r JOIN sym a ON a.id = r.caller_id JOIN sym b ON b.id = r.callee_id),
file_edges AS (SELECT DISTINCT caller_file, callee_file FROM edges WHERE caller_file != callee_file)
"""
#: The views of `nested`.
NESTED = VIEWS.replace("line, end_line, content_hash, params", "line, CASE WHEN kind IN ('class', 'struct', 'interface') THEN line + 400 ELSE end_line END AS end_line, content_hash, params", 1)
#: Whether `path` lies under a directory, in either slash style.
UNDER = lambda d: "(path ILIKE '%{f}/%' OR path ILIKE '%{f}' OR path ILIKE '%{b}\\%' OR path ILIKE '%{b}')".format(f=d, b=d.replace("/", "\\"))
