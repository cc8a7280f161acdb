"""Listings over the index: files, symbol trees, details, dependencies, figures and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lithoscope.functions.text import basename, like, slashes, strip_prefix
from lithoscope.plans.index import CodeIndex

CONTAINERS = ("class", "struct", "interface", "enum", "type")


def file_list(ix: CodeIndex) -> DataFrame:
    """Paths with at least one symbol."""
    return ix.symbols.where("kind != 'heading'").join(ix.scope, "file_id").select("path").distinct()


def symbol_tree(ix: CodeIndex) -> DataFrame:
    """`path, kind, name, line, end_line, depth, text`: depth is the number of containers whose lines hold the symbol's first."""
    s = ix.symbols.where("kind != 'heading'").withColumn("stop", F.coalesce("end_line", "line"))
    c = s.where(F.col("kind").isin(*CONTAINERS) & (F.col("stop") > F.col("line"))).select("file_id", F.col("id").alias("c_id"), F.col("line").alias("c_line"), F.col("stop").alias("c_stop"))
    depth = s.join(c, "file_id").where("c_id != id and c_line < line and c_stop >= line").groupBy("id").agg(F.count("*").alias("depth"))
    rows = s.join(depth, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)).cast("int")).join(ix.scope, "file_id")
    sig = F.when(F.coalesce("params", F.lit("")) != "", F.concat(F.lit("("), "params", F.lit(")"))).otherwise("")
    text = F.concat(F.expr("repeat('  ', depth + 1)"), "kind", F.lit(" "), "name", sig, F.lit(" ("), F.col("line").cast("string"), F.lit("-"), F.col("stop").cast("string"), F.lit(")"))
    return rows.select("path", "kind", "name", "line", F.col("stop").alias("end_line"), "depth", text.alias("text"))


def unindexed_dirs(ix: CodeIndex, directories: DataFrame) -> DataFrame:
    """The given directories under which no path is indexed."""
    parts = F.split(slashes("path"), "/")
    known = ix.paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")).distinct()
    return directories.select(F.regexp_replace(slashes("dir"), "/+$", "").alias("dir")).distinct().join(known, "dir", "left_anti")


def neighbours(ix: CodeIndex, n: int = 10) -> DataFrame:
    """`id, side, other, name`: up to n callers and callees of each symbol, by id."""
    names = ix.symbols.select(F.col("id").alias("other"), "name")
    e = ix.refs.select(F.col("callee_id").alias("id"), F.lit("caller").alias("side"), F.col("caller_id").alias("other")).unionByName(ix.refs.select(F.col("caller_id").alias("id"), F.lit("callee").alias("side"), F.col("callee_id").alias("other")))
    w = Window.partitionBy("id", "side").orderBy("other")
    return e.join(names, "other").join(ix.symbols.select("id"), "id", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("id", "side", "other", "name")


def detail(ix: CodeIndex, name: str, path_filter: str = "") -> DataFrame:
    """One row per symbol and path of a name: place, signature, description, callers, callees and blocks in order."""
    s = ix.symbols.where(F.col("name") == name)
    p = ix.paths.where(like("path", f"%{path_filter}%")) if path_filter else ix.paths
    # the symbol's own name leaves few rows: the neighbours of those only
    near = ix.refs.join(s.select(F.col("id").alias("callee_id")), "callee_id", "left_semi").select(F.col("callee_id").alias("id"), F.col("caller_id").alias("other"), F.lit(0).alias("side")).unionByName(ix.refs.join(s.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").select(F.col("caller_id").alias("id"), F.col("callee_id").alias("other"), F.lit(1).alias("side")))
    w = Window.partitionBy("id", "side").orderBy("other")
    near = near.join(ix.symbols.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other").withColumn("r", F.row_number().over(w)).where("r <= 10")
    listed = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("other", "other_name")))), lambda x: x["other_name"])
    near = near.groupBy("id").agg(listed(0).alias("callers"), listed(1).alias("callees"))
    blocks = ix.blocks.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").groupBy(F.col("symbol_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("block_index", "content"))), lambda x: x["content"]).alias("blocks"))
    none = F.array().cast("array<string>")
    return s.join(p, "file_id").join(near, "id", "left").join(blocks, "id", "left").select("id", "name", "kind", "path", "line", F.coalesce("end_line", "line").alias("end_line"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("params", F.lit("")).alias("params"), "nesting_depth", "param_count", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), F.coalesce("blocks", none).alias("blocks"))


def file_dependencies(ix: CodeIndex) -> DataFrame:
    """`caller, callee`: distinct pairs of different paths of which one calls into the other; the scope limits the callers."""
    a = ix.scope.select(F.col("file_id").alias("caller_file"), F.col("path").alias("caller"))
    b = ix.paths.select(F.col("file_id").alias("callee_file"), F.col("path").alias("callee"))
    return ix.edges.select("caller_file", "callee_file").distinct().join(a, "caller_file").join(b, "callee_file").where("caller != callee").select("caller", "callee").distinct()


def adjacency(edges: DataFrame, directory: str = "") -> DataFrame:
    """`text`: one line `caller -> callee, callee` per caller, paths relative to the directory."""
    rel = (lambda c: strip_prefix(c, directory)) if directory else slashes
    g = edges.select(rel("caller").alias("caller"), rel("callee").alias("callee")).groupBy("caller").agg(F.sort_array(F.collect_list("callee")).alias("l"))
    return g.select("caller", F.concat("caller", F.lit(" -> "), F.array_join("l", ", ")).alias("text"))


def resolve_files(ix: CodeIndex, asked: str) -> DataFrame:
    """The path that a name means: an exact base name first, then the shortest, then by letters."""
    hit = ix.paths.select("path").distinct().where(slashes("path").endswith(asked.replace("\\", "/")))
    return hit.orderBy(basename("path") != asked.rsplit("/", 1)[-1], F.length("path"), "path").limit(1)


def line_slice(texts: DataFrame, key: str, text: str, start: Column, end: Column, max_lines: int = 200) -> DataFrame:
    """`key, line_no, line`: the lines start..end of each text, numbered from 1, at most max_lines of them."""
    lines = texts.select(key, start.alias("start"), F.least(end, start + max_lines - 1).alias("stop"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.withColumn("line_no", F.col("pos") + 1).where("line_no between start and stop").select(key, "line_no", "line")


def numbered_slice(texts: DataFrame, key: str, path: str, text: str, start: int = 1, end: int = 0, max_lines: int = 200) -> DataFrame:
    """`key, shown`: a header with the lines shown and their number, then the lines, numbered; empty for an empty text.

    An end in front of the start means the last line; lines above `max_lines` are left
    out, and the header says how many.
    """
    first = max(1, start)
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    n = texts.select(key, F.col(path).alias("path"), F.col(text).alias("text"), lines.alias("lines")).withColumn("total", F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("lines")))
    wanted = F.least(F.lit(end), F.col("total")) if end >= first else F.col("total")
    n = n.withColumn("wanted", F.when(wanted < first, F.col("total")).otherwise(wanted)).withColumn("last", F.least(F.col("wanted"), F.lit(first + max_lines - 1)))
    width = F.length(F.col("last").cast("string"))
    body = F.transform(F.slice("lines", first, F.greatest(F.col("last") - first + 1, F.lit(0))), lambda x, i: F.concat(F.lpad((i + first).cast("string"), width, " "), F.lit("  "), x))
    rest = F.when(F.col("wanted") > F.col("last"), F.concat(F.lit(" [truncated; "), (F.col("wanted") - F.col("last")).cast("string"), F.lit(" more lines omitted]"))).otherwise("")
    head = F.concat("path", F.lit(f" (lines {first}-"), F.col("last").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"), rest)
    return n.select(key, F.when(F.col("total") == 0, "").otherwise(F.concat(head, F.lit("\n"), F.array_join(body, "\n"))).alias("shown"))


def tag_list(ix: CodeIndex) -> DataFrame:
    s = ix.symbols.join(ix.scope.select("file_id").distinct(), "file_id", "left_semi")
    return ix.tags.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select("key", "value").distinct()


def tagged(ix: CodeIndex, wanted: dict[str, str]) -> DataFrame:
    """Symbols that carry all wanted tags."""
    s = ix.symbols
    for k, v in wanted.items():
        s = s.join(ix.tags.where((F.col("key") == k) & (F.col("value") == v)).select(F.col("symbol_id").alias("id")), "id", "left_semi")
    return s.select("id", "name", "kind")


def summary(ix: CodeIndex, embeddings: DataFrame) -> DataFrame:
    """One row of counts and coverage percentages of the scope; symbols count once per path."""
    at = ix.symbols.where("kind != 'heading'").join(ix.scope, "file_id")
    known = embeddings.where("vector is not null").select("content_hash").distinct()
    embedded = ix.blocks.join(known, "content_hash", "left_semi").select(F.col("symbol_id").alias("id")).distinct().withColumn("embedded", F.lit(True))
    fn = F.col("kind").isin("function", "method")
    a = at.join(embedded, "id", "left").agg(
        F.count("*").alias("symbols"),
        F.countDistinct(F.when(F.col("embedded"), F.col("id"))).alias("embedded"),
        F.count(F.when(fn, 1)).alias("describable"),
        F.count(F.when(fn & F.col("description").isNotNull(), 1)).alias("described"),
    )
    pct = lambda x, y: F.when(F.col(y) > 0, F.floor(F.col(x) * 100 / F.col(y))).otherwise(0).cast("int")
    return ix.scope.agg(F.count("*").alias("files")).crossJoin(a).withColumn("embedded_pct", pct("embedded", "symbols")).withColumn("described_pct", pct("described", "describable"))


def recent_files(file_paths: DataFrame, now: Column, n: int = 10, seconds: int = 604_800) -> DataFrame:
    """The n paths changed last within a week."""
    return file_paths.groupBy("path").agg(F.max("mtime").alias("mtime")).where(F.col("mtime") > now - seconds).orderBy(F.desc("mtime"), "path").limit(n)


def findings_report(ix: CodeIndex, findings: DataFrame, rules: DataFrame, analyzers: tuple[str, ...] = (), names: tuple[str, ...] = (), severity: str = "", min_confidence: float = 0.0) -> DataFrame:
    """Findings with their rule and place, errors first."""
    f = findings.where(F.col("confidence") > 0).where(F.col("confidence") >= min_confidence)
    r = rules
    if analyzers:
        r = r.where(F.col("analyzer").isin(*analyzers))
    if names:
        r = r.where(F.col("rule_name").isin(*names))
    if severity:
        r = r.where(F.col("severity") == severity)
    s = ix.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), "file_id", "line")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    rows = f.join(F.broadcast(r), "rule_id").join(s, "symbol_id").join(ix.scope, "file_id")
    return rows.select("rule_id", "rule_name", "severity", rank.alias("severity_rank"), "message", "confidence", "symbol_name", "path", "line", "stale").orderBy("severity_rank", "path", "line")


def findings_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("rule_name", "severity", "message", "confidence", "symbol_name", F.col("path").alias("file_path"), "line")).alias("json"))


def severity_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count("*").alias("n"))
