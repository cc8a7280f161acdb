"""Incremental maintenance of the index: diffs, cascades, stale marks, purges and reference promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lithoscope.functions.text import slashes, under


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """`id, name, kind, ordinal, state`: unchanged, changed, new or removed by name, kind and place among equals.

    Unchanged and changed symbols keep their old id. old(id, file_id, name, kind,
    line, content_hash), new the same without id.
    """
    w = Window.partitionBy("file_id", "name", "kind").orderBy("line")
    key = ["file_id", "name", "kind", "ordinal"]
    o = old.withColumn("ordinal", F.row_number().over(w)).select("id", *key, F.col("content_hash").alias("was"), F.lit(True).alias("had"))
    n = new.withColumn("ordinal", F.row_number().over(w)).select(*key, F.col("content_hash").alias("now"), F.lit(True).alias("has"))
    state = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return n.join(o, key, "full_outer").select("id", *key, state.alias("state"))


def apply_symbol_diff(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """The new snapshot: ids of old symbols stay, descriptions only of unchanged ones; new ids are hashes of their key."""
    key = ["file_id", "name", "kind", "ordinal"]
    w = Window.partitionBy("file_id", "name", "kind").orderBy("line")
    n = new.withColumn("ordinal", F.row_number().over(w))
    keep = old.select("id", F.col("description").alias("old_description"))
    d = diff.where("state != 'removed'").join(keep, "id", "left")
    return n.drop("description").join(d, key).select(F.coalesce("id", F.xxhash64(*key)).alias("id"), "file_id", "name", "kind", "line", "content_hash", F.when(F.col("state") == "unchanged", F.col("old_description")).alias("description"), "state")


#: Priorities of queued work: of edits in files that were known before, and of new files.
EDITED, FRESH = 2, 1


def maintain(old: DataFrame, new: DataFrame, blocks: DataFrame, max_chars: int = 8000) -> dict[str, DataFrame]:
    """One step of upkeep of some files' symbols: `symbols`, `blocks`, `queues` and the `diff`.

    old and new as for `symbol_diff`, with snippet and end_line; blocks(symbol_id,
    block_index, content, content_hash, start_line, end_line) of the old symbols.
    Unchanged symbols keep description and blocks; changed and new ones get new blocks,
    which are queued to be described and embedded, and functions to be fingerprinted.
    """
    from lithoscope.session import materialise
    from lithoscope.sources.chunk import chunk_symbols

    diff = materialise(symbol_diff(old, new), "symbol-diff")
    snapshot = materialise(apply_symbol_diff(old, new, diff), "symbols")
    key = ["file_id", "name", "kind", "line"]
    touched = snapshot.where("state != 'unchanged'").join(new.select(*key, "snippet", "end_line"), key)
    columns = ["symbol_id", "block_index", "content", "content_hash", "start_line", "end_line"]
    kept = blocks.join(snapshot.where("state = 'unchanged'").select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select(*columns)
    fresh = chunk_symbols(touched, max_chars).select(*columns)
    return {"diff": diff, "symbols": snapshot, "blocks": kept.unionByName(fresh), "queues": downstream(touched, fresh, old.select("file_id").distinct())}


def downstream(touched: DataFrame, blocks: DataFrame, known_files: DataFrame) -> DataFrame:
    """`queue, symbol_id, block_index, priority`: the work that changed symbols(id, file_id, kind) and their blocks hand on."""
    known = known_files.withColumn("_known", F.lit(True))
    t = touched.join(known, "file_id", "left").select(F.col("id").alias("symbol_id"), "kind", F.when(F.col("_known"), EDITED).otherwise(FRESH).alias("priority"))
    per_block = blocks.select("symbol_id", "block_index").join(t, "symbol_id").select(F.explode(F.array(F.lit("describe"), F.lit("embed"))).alias("queue"), "symbol_id", "block_index", "priority")
    prints = t.where(F.col("kind").isin("function", "method")).select(F.lit("fingerprint").alias("queue"), "symbol_id", F.lit(None).cast("int").alias("block_index"), "priority")
    return per_block.unionByName(prints)


def upsert_paths(paths: DataFrame, seen: DataFrame) -> DataFrame:
    """`path, file_id, mtime, state` of seen paths: skipped where time and content are the known ones."""
    old = paths.select("path", F.col("file_id").alias("old_file"), F.col("mtime").alias("old_time"))
    state = F.when(F.col("old_file").isNull(), "added").when(F.col("old_file") != F.col("file_id"), "changed").when(F.col("old_time").eqNullSafe(F.col("mtime")), "skipped").otherwise("touched")
    return seen.join(old, "path", "left").select("path", "file_id", "mtime", state.alias("state"))


def mark_stale(findings: DataFrame, symbols: DataFrame, moved: DataFrame) -> DataFrame:
    """Findings of symbols in files that a path left, moved(file_id), become stale."""
    gone = symbols.join(moved.select("file_id").distinct(), "file_id", "left_semi").select(F.col("id").alias("symbol_id")).distinct().withColumn("_gone", F.lit(True))
    return findings.join(gone, "symbol_id", "left").withColumn("stale", F.coalesce("_gone", F.col("stale"))).drop("_gone")


def orphan_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files to which no path leads any more."""
    return files.join(paths.select("file_id").distinct(), "file_id", "left_anti")


def cascade(index: dict[str, DataFrame], gone_paths: DataFrame) -> dict[str, DataFrame]:
    """The index without the given paths and all that hangs on them: files, symbols, blocks, references."""
    paths = index["file_paths"].join(gone_paths.select("path").distinct(), "path", "left_anti")
    keep_files = paths.select("file_id").distinct()
    files = index["files"].join(keep_files, "file_id", "left_semi")
    symbols = index["symbols"].join(files.select("file_id").distinct(), "file_id", "left_semi")
    ids = symbols.select("id").distinct()
    blocks = index["code_blocks"].join(ids.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_semi")
    refs = index["symbol_refs"].join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi").join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
    ext = index["external_refs"].join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")
    return {"file_paths": paths, "files": files, "symbols": symbols, "code_blocks": blocks, "symbol_refs": refs, "external_refs": ext}


def in_folders(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths that are one of roots(dir) or lie under it: an equi-join on the ancestors."""
    parts = F.split(slashes("path"), "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    return up.join(roots.select(F.regexp_replace(slashes("dir"), "/+$", "").alias("dir")).distinct(), "dir", "left_semi").select("path").distinct()


def purge_reasons(paths: DataFrame, roots: DataFrame | None = None, present: DataFrame | None = None, worktrees: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """`path, reason`: indexed paths that should go: `explicit`, `missing`, `worktree` or `ignored`, the first that holds.

    roots(dir) and worktrees(dir) are directories; present(path) is what there is;
    rules(dir, line) are lines of ignore files.
    """
    from lithoscope.sources.ignore import ignored_paths

    p = paths.select("path").distinct()
    parts = []
    if roots is not None:
        parts.append(in_folders(p, roots).withColumn("rank", F.lit(0)))
    if present is not None:
        parts.append(p.join(present.select("path").distinct(), "path", "left_anti").withColumn("rank", F.lit(1)))
    if worktrees is not None:
        parts.append(in_folders(p, worktrees).withColumn("rank", F.lit(2)))
    if rules is not None:
        parts.append(ignored_paths(p, rules).withColumn("rank", F.lit(3)))
    every = reduce(DataFrame.unionByName, parts) if parts else p.limit(0).withColumn("rank", F.lit(0))
    names = F.array(*[F.lit(x) for x in ("explicit", "missing", "worktree", "ignored")])
    return every.groupBy("path").agg(F.min("rank").alias("rank")).select("path", F.element_at(names, F.col("rank") + 1).alias("reason"))


def folder_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """`dir, change` of two folder lists: added or removed."""
    a = new.select("dir").distinct().join(old, "dir", "left_anti").withColumn("change", F.lit("added"))
    return a.unionByName(old.select("dir").distinct().join(new, "dir", "left_anti").withColumn("change", F.lit("removed")))


def resolve_references(external: DataFrame, symbols: DataFrame) -> DataFrame:
    """`caller_id, callee_name, callee_id`: external names that are indexed functions by now.

    A name that several symbols bear means the smallest id in the caller's own file,
    else the smallest id; a symbol doesn't resolve to itself.
    """
    s = symbols.where(F.col("kind").isin("function", "method"))
    by_name = s.groupBy("name").agg(F.min("id").alias("any_id"))
    by_file = s.groupBy("file_id", "name").agg(F.min("id").alias("own_id"))
    home = symbols.select(F.col("id").alias("caller_id"), "file_id")
    e = external.select("caller_id", "callee_name").distinct().join(home, "caller_id")
    e = e.join(by_name.withColumnRenamed("name", "callee_name"), "callee_name").join(by_file.withColumnRenamed("name", "callee_name"), ["file_id", "callee_name"], "left")
    return e.select("caller_id", "callee_name", F.coalesce("own_id", "any_id").alias("callee_id")).where("callee_id != caller_id")


def enclosing(symbols: DataFrame, inner: tuple[str, ...] = ("function", "method"), outer: tuple[str, ...] = ("class", "struct", "interface")) -> DataFrame:
    """`id, outer_id, outer_name`: the innermost container whose lines hold the symbol."""
    a = symbols.where(F.col("kind").isin(*inner)).select("id", "file_id", F.col("line").alias("at"))
    b = symbols.where(F.col("kind").isin(*outer) & F.col("end_line").isNotNull()).select("file_id", F.col("id").alias("outer_id"), F.col("name").alias("outer_name"), "line", "end_line")
    j = a.join(b, "file_id").where("line <= at and end_line >= at and outer_id != id")
    return j.groupBy("id").agg(F.max_by(F.struct("outer_id", "outer_name"), F.struct("line", F.negative("outer_id"))).alias("o")).select("id", "o.outer_id", "o.outer_name")


def outermost(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """`file_id, line, callee, caller_id`: the first function by (start, end, name) whose lines hold a call."""
    j = calls.join(functions.select("file_id", "id", "name", F.col("line").alias("lo"), F.coalesce("end_line", "line").alias("hi")), "file_id").where("line between lo and hi")
    return j.groupBy("file_id", "line", "callee").agg(F.min_by("id", F.struct("lo", "hi", "name")).alias("caller_id"))


def missing_embeddings(blocks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Distinct block contents without a vector of the model."""
    known = embeddings.where((F.col("model") == model) & F.col("vector").isNotNull()).select("content_hash")
    return blocks.where("content_hash is not null").select("content_hash").distinct().join(known, "content_hash", "left_anti")


def rescan(paths: DataFrame, directory: str, exts: tuple[str, ...], priority: int) -> DataFrame:
    """`file_id, priority`: files to queue again, of a subtree and any of the extensions."""
    p = paths.where(under("path", directory))
    if exts:
        p = p.where(F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin(*[e.lower() for e in exts]))
    return p.select("file_id").distinct().withColumn("priority", F.lit(priority))
