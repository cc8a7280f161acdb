"""Scans of code trees, transcripts and settings as DataFrames."""

from __future__ import annotations

import hashlib
import re
import tomllib
from dataclasses import fields, is_dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lithoscope.functions.text import parse_branch
from lithoscope.sources.ignore import ignored_paths


def scan_tree(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = 50_000_000, streaming: bool = False) -> DataFrame:
    """`path, mtime, size, hash, content` of all files under a root; `hash` is the SHA-1 of the bytes, whatever the size.

    Files above `max_bytes` come without content: their bytes are read in pieces by the
    executors, so that no task has to hold them. As a stream, new and changed files.
    """
    def digest(paths: pd.Series) -> pd.Series:
        def one(p):
            if p is None:
                return None
            h = hashlib.sha1(usedforsecurity=False)
            with open_input(p) as f:
                while piece := f.read(1 << 20):
                    h.update(piece)
            return h.hexdigest()

        return paths.map(one)

    reader = (spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary") if streaming else spark.read).format("binaryFile")
    df = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    plain = [F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size")]
    small = df.where(F.col("length") <= max_bytes).select(*plain, F.sha1("content").alias("hash"), "content")
    large = df.where(F.col("length") > max_bytes).select(*plain, F.pandas_udf(digest, "string")("path").alias("hash"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def open_input(path: str):
    """A file of any storage that Arrow knows, as a stream of bytes."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, name = fs.FileSystem.from_uri("file://" + re.sub("^file:/+", "/", path) if path.startswith("file:") else path)
    else:
        system, name = fs.LocalFileSystem(), path
    return system.open_input_stream(name)


def side_files(files: DataFrame, name: str) -> DataFrame:
    """`dir, content` of the files called `name` beside or above a scan's files.

    Hidden files aren't listed by a scan, so each directory is asked for its own, on
    the executors; a directory in place of the file counts as none.
    """
    parts = F.split("path", "/")
    dirs = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")).distinct().where("dir != ''")

    def read(batches):
        from pyarrow import fs

        systems = {}
        for pdf in batches:
            rows = []
            for d in pdf["dir"]:
                scheme = d.partition("://")[0] if "://" in d else ""
                try:
                    if scheme not in systems:
                        systems[scheme] = fs.FileSystem.from_uri(d if scheme else f"file://{d}")[0]
                    info = systems[scheme].get_file_info(f"{d.partition('://')[2] if scheme else d}/{name}")
                    if info.type == fs.FileType.File:
                        rows.append((d, systems[scheme].open_input_file(info.path).read()))
                except (OSError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["dir", "content"])

    return dirs.mapInPandas(read, "dir string, content binary")


def without_ignored(files: DataFrame, ignore_name: str = ".gitignore") -> DataFrame:
    """A scan without what the tree's ignore files ignore, and without nested work trees (directories with a `.git` file)."""
    rules = side_files(files, ignore_name).select("dir", F.explode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line"))
    out = files.join(ignored_paths(files.select("path"), rules), "path", "left_anti")
    trees = side_files(files, ".git").select("dir")
    parts = F.split("path", "/")
    inside = out.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir")).join(trees, "dir", "left_semi").select("path").distinct()
    return out.join(inside, "path", "left_anti")


def git_log(lines: DataFrame) -> DataFrame:
    """`path, commit, author, branch` of lines(path, line) of `git log -1 --format=%H|%an|%D`; broken lines are left out."""
    p = F.split("line", r"\|", 3)
    ok = lines.where(F.size(p) == 3)
    return ok.select("path", F.trim(p[0]).alias("commit"), F.trim(p[1]).alias("author"), parse_branch(p[2]).alias("branch"))


def read_git(paths: DataFrame, git: str = "git") -> DataFrame:
    """`path, line`: what `git log` says of the newest commit of each path, asked for on the executors; nothing outside of repositories."""
    import subprocess

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                folder, _, base = p.replace("\\", "/").rpartition("/")
                try:
                    done = subprocess.run([git, "-C", folder or ".", "log", "-1", "--format=%H|%an|%D", "--", base], capture_output=True, text=True, timeout=30)
                except (OSError, subprocess.TimeoutExpired):
                    continue
                if done.returncode == 0 and done.stdout.strip():
                    rows.append((p, done.stdout.strip()))
            yield pd.DataFrame(rows, columns=["path", "line"])

    return paths.select("path").where("path is not null").distinct().mapInPandas(run, "path string, line string")


def upsert_repositories(known: DataFrame, roots: DataFrame) -> DataFrame:
    """`id, path, url`: the known repositories and those of roots(path, url) that are new, under ids from their paths."""
    new = roots.groupBy("path").agg(F.max("url").alias("url")).join(known.select("path"), "path", "left_anti")
    return known.select("id", "path", "url").unionByName(new.select(F.xxhash64("path").alias("id"), "path", F.coalesce("url", F.lit("")).alias("url")))


def common_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """`path, root, rel_path`: the deepest of roots(root) that a path lies under."""
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    up = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"), parts.alias("parts"))
    up = up.select("path", "k", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("root"), F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), "/").alias("rel"))
    j = up.join(roots.select("root").distinct(), "root")
    return j.groupBy("path").agg(F.max_by(F.struct("root", "rel"), "k").alias("r")).select("path", "r.root", F.col("r.rel").alias("rel_path"))


def transcripts(spark: SparkSession, folder: str, streaming: bool = False, archive: str | None = None) -> DataFrame:
    """`file, modified, type, session_id, uuid, message, content` of JSON-lines transcripts; broken lines are left out.

    As a stream the oldest files come first; with an `archive` they are moved there when done.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if streaming:
        reader = reader.option("latestFirst", "false")
    df = reader.text(folder, wholetext=False).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), "value")
    v = F.try_parse_json("value")
    get = lambda p: F.try_variant_get(v, p, "string")
    return df.where(v.isNotNull()).select("file", "modified", get("$.type").alias("type"), get("$.session_id").alias("session_id"), get("$.uuid").alias("uuid"), F.to_json(F.try_variant_get(v, "$.message", "variant")).alias("message"), get("$.content").alias("content"))


def merge_settings(defaults, text: str):
    """A dataclass of settings with the values of a TOML text over it, section by section; unknown keys are left out."""

    def over(obj, values):
        for f in fields(obj):
            if f.name in values:
                now = getattr(obj, f.name)
                if is_dataclass(now) and isinstance(values[f.name], dict):
                    over(now, values[f.name])
                else:
                    setattr(obj, f.name, values[f.name])
        return obj

    return over(defaults, tomllib.loads(text))


def fill_secrets(conf, text: str, section: str = "llm", name: str = "api_key"):
    """Settings with a secret from another TOML text wherever a field of that name is still empty; broken texts change nothing."""
    try:
        secret = tomllib.loads(text).get(section, {}).get(name, "")
    except tomllib.TOMLDecodeError:
        secret = ""

    def fill(obj):
        for f in fields(obj):
            now = getattr(obj, f.name)
            if is_dataclass(now):
                fill(now)
            elif isinstance(now, list):
                for x in now:
                    if is_dataclass(x):
                        fill(x)
            elif f.name == name and not now:
                setattr(obj, name, secret)

    if secret:
        fill(conf)
    return conf


#: What an analyzer has unless its file says otherwise.
ANALYZER_DEFAULTS = {"min_lines": 5, "kinds": ["function", "method"], "extensions": [], "confidence": 0.7, "max_context_callers": 3, "max_context_callees": 5, "file_mode": False}


def analyzers(text: str) -> list[dict]:
    """The analyzers of a TOML text with their rules (name, severity, description)."""
    out = []
    for a in tomllib.loads(text).get("analyzers", []):
        rules = [{"name": r.get("name", ""), "severity": r.get("severity", "warning"), "description": r.get("description", "")} for r in a.get("rules", [])]
        out.append({"name": "", "description": ""} | ANALYZER_DEFAULTS | a | {"rules": rules})
    return out


def suppression_table(files: DataFrame) -> DataFrame:
    """`dir, rule` of suppression files(path, content): TOML with a list `suppress`."""

    def read(batches):

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    names = tomllib.loads(bytes(content).decode("utf-8", "replace")).get("suppress", [])
                except tomllib.TOMLDecodeError:
                    continue
                rows += [(path.rsplit("/", 1)[0], str(n)) for n in names]
            yield pd.DataFrame(rows, columns=["dir", "rule"])

    return files.select("path", "content").mapInPandas(read, "dir string, rule string")
