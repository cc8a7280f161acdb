"""Ignore rules: globs of ignore files as regular expressions, matched in one pass over paths.

Defined behaviour: case is ignored; blank, `#` and `!` lines are skipped; a pattern
without a slash meets base names, one with a slash the path from the rules'
directory; a trailing slash meets only directories, and so all files below; `**`
crosses slashes, `*` and `?` don't; brackets are literal; a leading slash never
matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lithoscope.functions.text import slashes


@dataclass(frozen=True)
class IgnoreRule:
    kind: str  # exact, suffix, prefix, contains or regexp
    value: str
    dir_only: bool
    has_slash: bool


def glob_to_regex(glob: str) -> str:
    out = re.sub(r"\*\*|\*|\?|[.()\[\]{}+^$|\\]", lambda m: {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0], "\\" + m[0]), glob)
    return f"^{out}$"


def parse_rule(line: str) -> IgnoreRule | None:
    """One line of an ignore file; None where it has no pattern."""
    glob = line.strip()
    if not glob or glob[0] in "#!":
        return None
    dir_only, glob = glob.endswith("/"), glob.removesuffix("/").lower()
    inner = glob.strip("*")
    plain = "*" not in inner and "?" not in glob and "[" not in glob
    match (glob.count("*"), glob[:1] == "*", glob[-1:] == "*"):
        case (0, _, _) if plain:
            kind, value = "exact", glob
        case (1, True, _) if plain:
            kind, value = "suffix", inner
        case (1, _, True) if plain:
            kind, value = "prefix", inner
        case (2, True, True) if plain and inner:
            kind, value = "contains", inner
        case _:
            kind, value = "regexp", glob_to_regex(glob)
    return IgnoreRule(kind, value, dir_only, "/" in glob)


#: How a lower-cased target meets the value of a rule, by its kind: only the last needs a regular expression.
MEETS = {
    "exact": lambda target, value: target == value,
    "suffix": lambda target, value: target.endswith(value),
    "prefix": lambda target, value: target.startswith(value),
    "contains": lambda target, value: value in target,
    "regexp": lambda target, value: re.search(value, target) is not None,
}


def parse_rules(text: str) -> list[IgnoreRule]:
    return [r for r in map(parse_rule, text.splitlines()) if r]


def is_ignored(rel: str, rules: list[IgnoreRule], is_dir: bool = False) -> bool:
    """Whether one path, relative to the rules' directory, is ignored."""
    parts = rel.replace("\\", "/").lower().split("/")
    for r in rules:
        ends = range(1, len(parts)) if r.dir_only and not is_dir else [len(parts)]
        if any(MEETS[r.kind]("/".join(parts[:k]) if r.has_slash else parts[k - 1], r.value) for k in ends):
            return True
    return False


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """`path` of paths that some rule(dir, line) ignores.

    Each path meets the rules of its own ancestors only, through an equi-join; the
    lines are turned into one expression per directory first.
    """

    def compile_(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for d, line in zip(pdf["dir"], pdf["line"]):
                r = parse_rule(line or "")
                if r:
                    rows.append((d.replace("\\", "/").rstrip("/"), r.kind, r.value, r.dir_only, r.has_slash))
            yield pd.DataFrame(rows, columns=["dir", "kind", "value", "dir_only", "has_slash"])

    table = rules.select("dir", "line").mapInPandas(compile_, "dir string, kind string, value string, dir_only boolean, has_slash boolean")
    parts = F.split(F.lower(slashes("path")), "/")
    up = paths.select("path", F.split(slashes("path"), "/").alias("raw"), parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k"))
    up = up.withColumn("dir", F.array_join(F.slice("raw", 1, F.col("k")), "/"))
    j = up.join(table, "dir").withColumn("rest", F.slice("parts", F.col("k") + 1, F.size("parts")))
    last = F.size("rest")
    ends = F.when(F.col("dir_only"), F.when(last > 1, F.sequence(F.lit(1), last - 1)).otherwise(F.array().cast("array<int>"))).otherwise(F.array(last))
    target = F.explode(F.transform(ends, lambda e: F.when(F.col("has_slash"), F.array_join(F.slice("rest", 1, e), "/")).otherwise(F.element_at("rest", e))))
    meets = "case kind when 'exact' then target = value when 'suffix' then endswith(target, value) when 'prefix' then startswith(target, value) when 'contains' then contains(target, value) else target rlike value end"
    return j.select("path", "kind", "value", target.alias("target")).where(F.expr(meets)).select("path").distinct()
