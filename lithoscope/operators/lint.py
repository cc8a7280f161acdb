"""Lint rules: each is a DataFrame `path, line, rule, display, score` over a code index.

A rule takes the index and a threshold; `rule` registers it, so that further rules
plug in. A symbol or file that lies under several paths is reported under the
smallest. Scores are the measured value over the threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lithoscope.functions.text import fixed, module_of
from lithoscope.operators.clones import exact_clones, near_clones
from lithoscope.operators.components import components
from lithoscope.plans.index import CodeIndex

CODE = ("function", "method")


@dataclass(frozen=True)
class Rule:
    check: Callable[[CodeIndex, int], DataFrame]
    default: int | None  # None: only on request
    emits: tuple[str, ...]


RULES: dict[str, Rule] = {}


def rule(default: int | None, *emits: str):
    def register(f):
        RULES[f.__name__] = Rule(f, default, emits or (f.__name__,))
        return f

    return register


def _home(ix: CodeIndex) -> DataFrame:
    """One path per content file of the scope."""
    return ix.scope.groupBy("file_id").agg(F.min("path").alias("path"))


def _report(df: DataFrame, name: str, display: Column, value: Column, t: int, line: Column | None = None) -> DataFrame:
    score = (value / F.lit(float(max(t, 1)))).cast("double")
    return df.select("path", (F.lit(1) if line is None else line).cast("int").alias("line"), F.lit(name).alias("rule"), display.alias("display"), score.alias("score"))


def _named(text: str, value: str = "value") -> Column:
    front, back = text.split("{}")
    return F.concat(F.col("name"), F.lit(front), F.col(value).cast("string"), F.lit(back))


def _per_path(ix: CodeIndex, condition: Column, value: Column, name: str, text: str, t: int) -> DataFrame:
    """Rules on one number of a function: a row for each path."""
    rows = ix.symbols.where(F.col("kind").isin(*CODE)).withColumn("value", value).where(condition & (F.col("value") > t))
    return _report(rows.join(ix.scope, "file_id"), name, _named(text), F.col("value"), t, F.col("line"))


@rule(40)
def long_function(ix: CodeIndex, t: int) -> DataFrame:
    return _per_path(ix, F.col("end_line").isNotNull(), F.col("end_line") - F.col("line"), "long_function", " ({} lines)", t)


@rule(4)
def too_many_params(ix: CodeIndex, t: int) -> DataFrame:
    return _per_path(ix, F.lit(True), F.col("param_count"), "too_many_params", " ({} params)", t)


@rule(3)
def deep_nesting(ix: CodeIndex, t: int) -> DataFrame:
    return _per_path(ix, F.lit(True), F.col("nesting_depth"), "deep_nesting", " (depth {})", t)


@rule(20)
def god_file(ix: CodeIndex, t: int) -> DataFrame:
    """Symbols per file, counted once per path of the file."""
    n = ix.symbols.where("kind != 'heading'").groupBy("file_id").agg(F.count("*").alias("n"))
    at = ix.scope.groupBy("file_id").agg(F.min("path").alias("path"), F.count("*").alias("paths"))
    rows = n.join(at, "file_id").withColumn("value", F.col("n") * F.col("paths")).where(F.col("value") > t)
    return _report(rows, "god_file", F.concat(F.col("value").cast("string"), F.lit(" symbols")), F.col("value"), t)


@rule(8)
def high_fan_out(ix: CodeIndex, t: int) -> DataFrame:
    """Distinct callees plus distinct external names; two counts, so that no product is built."""
    inner = ix.refs.groupBy(F.col("caller_id").alias("id")).agg(F.count("*").alias("a"))
    outer = ix.external.groupBy(F.col("caller_id").alias("id")).agg(F.count("*").alias("b"))
    rows = ix.symbols.where(F.col("kind").isin(*CODE)).join(inner, "id", "left").join(outer, "id", "left")
    rows = rows.withColumn("value", F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).where(F.col("value") > t)
    return _report(rows.join(_home(ix), "file_id"), "high_fan_out", _named(" ({} callees)"), F.col("value"), t, F.col("line"))


@rule(None)
def unused_symbol(ix: CodeIndex, t: int) -> DataFrame:
    rows = ix.symbols.where(F.col("kind").isin(*CODE)).join(ix.refs.select(F.col("callee_id").alias("id")), "id", "left_anti")
    return _report(rows.join(ix.scope, "file_id"), "unused_symbol", F.col("name"), F.lit(1.0), 1, F.col("line"))


@rule(None)
def static_symbol(ix: CodeIndex, t: int) -> DataFrame:
    static = ix.tags.where("key = 'is_static' and value = 'true'").select(F.col("symbol_id").alias("id"))
    rows = ix.symbols.join(static, "id", "left_semi").join(ix.scope, "file_id")
    return _report(rows, "static_symbol", F.concat("name", F.lit(" ("), "kind", F.lit(")")), F.lit(1.0), 1, F.col("line"))


@rule(10)
def wide_module(ix: CodeIndex, t: int) -> DataFrame:
    n = ix.file_edges.groupBy(F.col("caller_file").alias("file_id")).agg(F.count("*").alias("value")).where(F.col("value") > t)
    return _report(n.join(_home(ix), "file_id"), "wide_module", F.concat(F.col("value").cast("string"), F.lit(" file dependencies")), F.col("value"), t)


def _callees_by_path(ix: CodeIndex) -> DataFrame:
    """`path, callee_path, dir` of each path's called files."""
    return ix.file_edges.join(ix.scope.withColumnRenamed("file_id", "caller_file"), "caller_file").join(ix.file_dirs.withColumnRenamed("file_id", "callee_file"), "callee_file").select("path", "callee_path", "dir").distinct()


@rule(5)
def wide_package(ix: CodeIndex, t: int) -> DataFrame:
    n = _callees_by_path(ix).groupBy("path").agg(F.countDistinct("dir").alias("value")).where(F.col("value") > t)
    return _report(n, "wide_package", F.concat(F.col("value").cast("string"), F.lit(" packages")), F.col("value"), t)


@rule(None)
def dep_spread(ix: CodeIndex, t: int) -> DataFrame:
    deps = _callees_by_path(ix).groupBy("path").agg(F.countDistinct("callee_path").alias("deps"))
    total = ix.symbols.join(ix.scope, "file_id").groupBy("path").agg(F.count("*").alias("total"))
    rows = deps.join(total, "path", "left").withColumn("total", F.greatest(F.coalesce("total", F.lit(1)), F.lit(1))).withColumn("value", F.expr("deps * 100 div total")).where(F.col("value") > t)
    display = F.concat(F.col("value").cast("string"), F.lit("% spread ("), F.col("deps").cast("string"), F.lit(" deps, "), F.col("total").cast("string"), F.lit(" symbols)"))
    return _report(rows, "dep_spread", display, F.col("value"), t)


def _contained(ix: CodeIndex, kinds: tuple[str, ...], members: tuple[str, ...]) -> DataFrame:
    """`class_id, class_name, class_line, file_id, member_id`: members inside of a container's lines."""
    c = ix.symbols.where(F.col("kind").isin(*kinds) & F.col("end_line").isNotNull()).select(F.col("id").alias("class_id"), F.col("name").alias("class_name"), F.col("line").alias("class_line"), F.col("end_line").alias("class_end"), "file_id")
    m = ix.symbols.where(F.col("kind").isin(*members)).select(F.col("id").alias("member_id"), F.col("line").alias("m_line"), F.col("end_line").alias("m_end"), "file_id")
    return c.join(m, "file_id").where("m_line > class_line and m_end <= class_end")


@rule(10)
def fat_class(ix: CodeIndex, t: int) -> DataFrame:
    n = _contained(ix, ("class", "struct", "interface"), ("method",)).groupBy("class_id", "class_name", "class_line", "file_id").agg(F.count("*").alias("value")).where(F.col("value") > t)
    return _report(n.withColumnRenamed("class_name", "name").join(_home(ix), "file_id"), "fat_class", _named(" ({} methods)"), F.col("value"), t, F.col("class_line"))


@rule(None)
def split_class(ix: CodeIndex, t: int) -> DataFrame:
    """Classes whose methods fall into at least `t` groups that don't call each other.

    Groups are methods minus the links of the classes' call forests: components of
    the graph of (class, method) nodes.
    """
    inside = _contained(ix, ("class", "struct"), CODE).select("class_id", "class_name", "file_id", "member_id").distinct()
    node = lambda c, m: F.concat_ws(":", F.col(c).cast("string"), F.lpad(F.col(m).cast("string"), 20, "0"))
    a = inside.select("class_id", F.col("member_id").alias("caller_id"))
    b = inside.select("class_id", F.col("member_id").alias("callee_id"))
    links = ix.refs.join(a, "caller_id").join(b, ["class_id", "callee_id"]).select(node("class_id", "caller_id").alias("u"), node("class_id", "callee_id").alias("v"))
    label = components(links, "u", "v")
    groups = inside.withColumn("node", node("class_id", "member_id")).join(label, "node", "left").groupBy("class_id", "class_name", "file_id").agg(F.count("*").alias("methods"), F.countDistinct(F.coalesce("component", "node")).alias("value"))
    rows = groups.where((F.col("methods") >= 2) & (F.col("value") >= t)).withColumnRenamed("class_name", "name").join(ix.scope, "file_id")
    return _report(rows, "split_class", _named(" ({} disconnected method groups)"), F.col("value"), t)


@rule(None)
def mixed_abstraction(ix: CodeIndex, t: int) -> DataFrame:
    """Functions that call both much-used files (from 5 files or more) and hardly used ones (from 1 at most)."""
    inbound = ix.file_edges.groupBy("callee_file").agg(F.count("*").alias("n"))
    calls = ix.edges.where("caller_file != callee_file").select("caller_id", "callee_file").distinct().join(inbound, "callee_file")
    n = calls.groupBy("caller_id").agg(F.count(F.when(F.col("n") >= 5, 1)).alias("high"), F.count(F.when(F.col("n") <= 1, 1)).alias("low")).where((F.col("high") >= t) & (F.col("low") >= t))
    rows = n.join(ix.symbols.where(F.col("kind").isin(*CODE)).withColumnRenamed("id", "caller_id"), "caller_id").join(_home(ix), "file_id")
    display = F.concat("name", F.lit(" mixes "), F.col("high").cast("string"), F.lit(" high-level + "), F.col("low").cast("string"), F.lit(" low-level deps"))
    return _report(rows, "mixed_abstraction", display, F.col("high") + F.col("low"), 2 * t, F.col("line"))


@rule(3, "dip_hint")
def dip_violation(ix: CodeIndex, t: int) -> DataFrame:
    """Modules that depend on a module with more dependents than they have themselves."""
    ns = ix.tags.where("key = 'namespace'").join(ix.symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id").groupBy("file_id").agg(F.min("value").alias("ns"))
    at = ix.scope.join(ns, "file_id", "left").select("file_id", "path", module_of("path", "ns").alias("module"))
    e = ix.edges.where("caller_ext = callee_ext").select("caller_file", "callee_file").distinct()
    e = e.join(at.select(F.col("file_id").alias("caller_file"), F.col("path"), F.col("module").alias("u")), "caller_file").join(at.select(F.col("file_id").alias("callee_file"), F.col("path").alias("callee_path"), F.col("module").alias("v")), "callee_file")
    e = e.where("path != callee_path and u != v").groupBy("u", "v").agg(F.min("path").alias("path"))
    first = e.groupBy("u").agg(F.min("path").alias("path"))
    inbound = e.groupBy(F.col("v").alias("m")).agg(F.count("*").alias("n"))
    rows = e.select("u", "v").join(first, "u").join(inbound.select(F.col("m").alias("v"), F.col("n").alias("value")), "v").join(inbound.select(F.col("m").alias("u"), F.col("n").alias("own")), "u", "left")
    rows = rows.where((F.col("value") >= t) & (F.coalesce("own", F.lit(0)) < F.col("value")))
    display = F.concat(F.lit("may depend on lower-level module "), "v", F.lit(" ("), F.col("value").cast("string"), F.lit(" dependents)"))
    return _report(rows, "dip_hint", display, F.col("value"), t)


@rule(3, "exact_clone", "near_clone")
def duplicate_symbol(ix: CodeIndex, t: int) -> DataFrame:
    """One row per group of exact clones, and per group of near clones (`t` < 0: none)."""
    exact = exact_clones(ix)
    display = F.concat(F.lit("exact clone: "), "name", F.lit(" ("), F.col("n").cast("string"), F.lit(" copies, hash "), F.substring("hash", 1, 8), F.lit(")"))
    out = _report(exact, "exact_clone", display, F.lit(2.0), 1, F.col("line"))
    if t < 0:
        return out
    near = near_clones(ix, t).groupBy("component").agg(F.count("*").alias("n"), F.min("distance").alias("d"), F.min(F.struct("path", "line")).alias("at")).select("n", "d", "at.path", "at.line")
    display = F.concat(F.lit("near-clone group: "), F.col("n").cast("string"), F.lit(" symbols, closest distance "), F.col("d").cast("string"))
    return out.unionByName(_report(near, "near_clone", display, F.lit(1.0) + (t - F.col("d")) / float(max(t, 1)), 1, F.col("line")))


def lint(ix: CodeIndex, thresholds: dict[str, int | None] | None = None, suppressions: DataFrame | None = None, min_score: float = 0.0) -> DataFrame:
    """All rules that are on, in one plan, ordered by score, path and line.

    `thresholds` overrides defaults (None or a negative number turns a rule off).
    suppressions(dir, rule): under `dir`, `rule` (its own or an emitted name, `*`:
    all) isn't reported.
    """
    on = {n: r.default for n, r in RULES.items()} | (thresholds or {})
    parts = [RULES[n].check(ix, t) for n, t in on.items() if t is not None and t >= 0]
    out = reduce(DataFrame.unionByName, parts).where(F.col("score") >= min_score)
    if suppressions is not None:
        out = suppress(out, suppressions)
    return out.orderBy(F.desc("score"), "path", "line")


def suppress(found: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Without the rows whose path lies in a directory that suppresses their rule: an equi-join on the ancestors."""
    owner = {e: n for n, r in RULES.items() for e in r.emits}
    alias = F.create_map(*[F.lit(x) for kv in owner.items() for x in kv])
    s = suppressions.select(F.regexp_replace(F.replace("dir", F.lit("\\"), F.lit("/")), "/+$", "").alias("dir"), F.col("rule").alias("off")).distinct()
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    keyed = found.withColumn("key", F.xxhash64("path", "line", "rule", "display"))
    up = keyed.select("key", "rule", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("dir"))
    hit = up.join(s, "dir").where((F.col("off") == "*") | (F.col("off") == F.col("rule")) | (F.col("off") == alias[F.col("rule")])).select("key").distinct()
    return keyed.join(hit, "key", "left_anti").drop("key")


def confusing(ix: CodeIndex, tags: DataFrame) -> DataFrame:
    """`path, line, name, reason`: functions that tags(symbol_id, key, value) call confusing, with the reason where there is one."""
    of = lambda key, name: tags.where(F.col("key") == key).groupBy(F.col("symbol_id").alias("id")).agg(F.min("value").alias(name))
    rows = ix.symbols.where(F.col("kind").isin(*CODE)).join(of("confusing", "said").where("said = 'true'"), "id", "left_semi").join(of("confusing_reason", "why"), "id", "left")
    return rows.join(ix.scope, "file_id").select("path", "line", "name", F.coalesce("why", F.lit("")).alias("reason")).orderBy("path", "line")


def report_text(found: DataFrame) -> DataFrame:
    """`text`: one line per finding: place and rule in columns, how often the threshold, what was found."""
    wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    place = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    return found.select(F.concat(F.lit("  "), wide(place, 60), F.lit(" "), wide(F.col("rule"), 22), F.lit("  "), fixed("score", 1, 5), F.lit("x  "), "display").alias("text"))


def totals_text(found: DataFrame, symbols: DataFrame, unclear: DataFrame | None = None, directory: str = "") -> DataFrame:
    """`text`, one row: the line below a report: symbols, findings, findings per 100 symbols, confusing symbols."""
    d = density(found, symbols).crossJoin((found.limit(0) if unclear is None else unclear).agg(F.count("*").alias("confusing")))  # one row each
    per100 = F.coalesce("per100", F.lit(0.0)).cast("double").cast("string")
    return d.select(F.concat(F.lit(f"  {directory or '(all)'}  symbols="), F.col("symbols").cast("string"), F.lit(" violations="), F.col("total").cast("string"), F.lit(" per100s="), per100, F.lit(" confusing="), F.col("confusing").cast("string")).alias("text"))


def density(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """`total, symbols, per100`: findings per 100 symbols."""
    return found.agg(F.count("*").alias("total")).crossJoin(symbols.agg(F.count("*").alias("symbols"))).withColumn("per100", F.round(F.col("total") * 100 / F.nullif(F.col("symbols"), F.lit(0)), 2))
