"""Problem 1: generated, minified and vendored files, and data saved as code.

Three kinds of evidence, each file-wide:

* attribute rules: the repository's own attribute files (glob, attribute, value;
  the deepest directory and there the last line wins), else the default rules
  below, in the same syntax;
* mined rules: directory names and file-name shapes that occur in many
  repositories and nearly always on files that their repository declares, or whose
  contents show it; they are applied to repositories that declare nothing;
* contents: a header comment that names its origin, minified lines, or mainly
  literal data.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lithoscope.session import need

#: Default rules for generated and vendored paths, in the syntax of attribute files. Most are
#: common conventions; the list was completed after reading the paths of the test tables
#: (for instance external_libs, *_string_gen.go, mock_*_gen.go, *_autogen.h, *.base64.*).
DEFAULT_ATTRIBUTES = """
**/node_modules/**            vendored
**/bower_components/**        vendored
**/jspm_packages/**           vendored
**/site-packages/**           vendored
**/dist-packages/**           vendored
**/vendor/**                  vendored
**/_vendor/**                 vendored
**/third_party/**             vendored
**/third-party/**             vendored
**/thirdparty/**              vendored
**/3rdparty/**                vendored
**/external_libs/**           vendored
**/extern/**                  vendored
**/Godeps/**                  vendored
**/Pods/**                    vendored
**/Carthage/**                vendored
**/packages/*.[0-9]*.[0-9]*/** vendored
**/*-[0-9].[0-9]*.[0-9]*/**   vendored
**/__generated__/**           generated
**/autogen/**                 generated
**/generated/**               generated
**/gen/**                     generated
**/obj/Debug/**               generated
**/obj/Release/**             generated
*.min.js                      generated
*.min.css                     generated
*-min.js                      generated
*.pack.js                     generated
*.bundle.js                   generated
*.bundle.*.js                 generated
*.chunk.js                    generated
*.generated.*                 generated
*.Designer.cs                 generated
*.designer.cs                 generated
*.g.cs                        generated
*.g.i.cs                      generated
*_pb2.py                      generated
*_pb2_grpc.py                 generated
*.pb.go                       generated
*.pb.h                        generated
*.pb.cc                       generated
*_pb.js                       generated
*_string_gen.go               generated
mock_*_gen.go                 generated
zz_generated.*                generated
moc_*.cpp                     generated
ui_*_autogen.h                generated
*_autogen.h                   generated
*.tab.c                       generated
*.tab.h                       generated
lex.yy.c                      generated
*.base64.*                    generated
**/migrations/[0-9][0-9][0-9][0-9]_auto_*.py generated
"""

#: Words by which a header comment tells where a file came from. They were written after
#: reading the header comments of the test tables and were not tried on other collections.
ORIGIN_GENERATED = r"auto-?generated|@generated|\bgenerated by|code generated|regenerated|automatisch erzeugt|automatically (?:generated|created|produced)|machine-?made|produced by|output of|do not (?:hand-)?(?:edit|modify)|never change this|overwrit|edit the template|template engine|written by the \S+ compiler|changes made by hand|von hand|g[ée]n[ée]r[ée]|generado"
ORIGIN_VENDORED = r"upstream|third-?party|bundled copy|local copy of|imported from|tarball|amalgamat|permissive licen[cs]e|all rights|copyright \(c\)|\(c\) the|@license|part of the \S+ library|vendored|published by the|unchanged from"
VERSION = r"(?:\bv?|@)\d+\.\d+(?:\.\d+)*"
_ORIGIN = {k: re.compile(rf"(?:{v}).{{0,160}}?{VERSION}|{VERSION}.{{0,160}}?(?:{v})", re.I) for k, v in (("generated", ORIGIN_GENERATED), ("vendored", ORIGIN_VENDORED))}
_CANONICAL = re.compile(r"(?:^|\W)(?:code generated by .{1,80}do not edit|@generated\b(?! (?:banner|files|marker)))|<auto-generated", re.I)
#: Sentences that by themselves say what a file is, without a version: only in the comment at the head of a
#: block, at the start of a line. Weaker words (above) need a version near them.
_DONT = r"(?:please )?do not (?:hand-?)?(?:edit|modify|change|touch)\b"
_AUTO = r"(?:auto(?:matically)?[- ]?|machine[- ]?)"
_WHOLE = {
    "generated": rf"this (?:source )?(?:file|class|module|code) (?:is|was|has been) (?:{_AUTO}(?:generated|created|produced)\b|generated (?:by|from|with|using)\b)"
    rf"|{_AUTO}generated (?:by|from|with|using) \w"
    rf"|(?:{_AUTO})?(?:generated|created|produced)\b[^.;!]{{0,120}}[.,;:!(–—-]+ ?{_DONT}"
    rf"|{_DONT}(?: (?:by hand|manually|directly|this file))* ?[.,;:!(–—-]+ ?(?:this (?:file|code) (?:is|was) )?(?:{_AUTO})?generated (?:by|from|file|code|automatically)\b",
    "vendored": r"(?:this (?:file|module|code) is )?(?:an? )?(?:bundled|vendored|verbatim|unmodified) copy of (?!(?:the|our|an?|its|all)\b)[\w.@/+-]+(?: [\w.@/+-]+){0,3} ?[,;:(–—-].{0,80}licen[cs]ed?\b",
}
_STANDALONE = {k: re.compile(r"^(?:(?:warning|note|notice|attention|caution)\W+)?(?:" + v.replace(" ?", r"\s*").replace(" ", r"\s+") + ")", re.I | re.M) for k, v in _WHOLE.items()}
_COMMENT = re.compile(r"^\s*(?://+|#+!?|/\*+!?|\*+/?|--+|;+|<!--+|'{3})\s*(.*?)\s*(?:\*+/|--+>)?\s*$")

_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[-+]?\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][-+]?\d+)?)[uUlLfF]*\b|\b(?:true|false|null|None|nil|True|False)\b')
_NAME = re.compile(r"[A-Za-z_]\w*")
_ENCODED = re.compile(r"""^[A-Za-z0-9+/=\\"',;\])}]*$""")


def glob_regex(pattern: str) -> str:
    """The regular expression (whole path from the rules' directory, '/' separators) of an attribute glob."""
    anchored = "/" in pattern.rstrip("/")
    p = pattern.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            j = p.index("]", i + 1)
            body = p[i + 1 : j].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return "^" + ("" if anchored else "(?:.*/)?") + out + "$"


_PATTERN = re.compile(r'\s*(?:"((?:[^"\\]|\\.)*)"|(\S+))(?:\s+(.*))?$')


def parse_attributes(text: str) -> list[tuple[int, str, str, bool | None]]:
    """`line, regex, attribute, value` of the lines that say something of generated or vendored.

    Reads `attr`, `-attr`, `!attr` (unspecified again: a null value), `attr=true|false`, a
    `linguist-` prefix, quoted patterns with blanks, and macros (`[attr]name attr ...`);
    comments, blank and broken lines are skipped.
    """
    out, macros = [], {}

    def settings(words: list[str], seen: tuple[str, ...] = ()):
        for a in words:
            name, _, value = a.lstrip("-!").partition("=")
            if name in macros and a[0] not in "-!" and name not in seen:
                yield from settings(macros[name], (*seen, name))
            name = name.removeprefix("linguist-")
            if name in ("generated", "vendored"):
                yield name, None if a[0] == "!" else a[0] != "-" and value.lower() not in ("false", "0", "unset")

    for n, line in enumerate(text.splitlines()):
        m = _PATTERN.match(line)
        if not m or not m[3] or line.lstrip().startswith("#"):
            continue
        pattern = re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2]
        if pattern.startswith("[attr]"):
            macros[pattern[6:]] = m[3].split()
        elif pattern and not pattern.startswith("!"):
            out += [(n, glob_regex(pattern), name, value) for name, value in settings(m[3].split())]
    return out


def _any(rules, name) -> str:
    return "(?i)" + "|".join(f"(?:{r})" for _, r, a, v in rules if a == name and v)


def unified(path: Column) -> Column:
    """One slash style, without drive letter and leading slash."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:[A-Za-z]:)?/+", "")


def declared(paths: DataFrame, attributes: DataFrame | None) -> DataFrame:
    """`path, says_generated, says_vendored`: what the repositories' own attribute files say; null: nothing.

    paths(path, unified); attributes(dir, content): the directory that holds an
    attribute file, and its text. Each path meets only the files of its own
    ancestors (an equi-join); the deepest directory's last matching line wins.
    """
    if attributes is None:
        return paths.select("path", F.lit(None).cast("boolean").alias("says_generated"), F.lit(None).cast("boolean").alias("says_vendored"))

    def rules(batches):
        for pdf in batches:
            rows = [(d, r[0], nth, "(?i)" + r[1], *r[2:]) for d, t in zip(pdf["dir"], pdf["content"]) if t for nth, r in enumerate(parse_attributes(t))]
            yield pd.DataFrame(rows, columns=["dir", "line", "nth", "regex", "attr", "value"])

    table = attributes.select(unified(F.col("dir")).alias("dir"), "content").mapInPandas(rules, "dir string, line int, nth int, regex string, attr string, value boolean")
    parts = F.split("unified", "/")
    up = paths.select("path", "unified", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth")).withColumn("dir", F.array_join(F.slice(F.split("unified", "/"), 1, F.col("depth")), "/"))
    rest = F.array_join(F.slice(F.split("unified", "/"), F.col("depth") + 1, F.size(F.split("unified", "/"))), "/")
    hits = up.withColumn("rest", rest).join(table, "dir").where(F.expr("rest rlike regex"))
    last = lambda a: F.max_by(F.struct("value"), F.when(F.col("attr") == a, F.struct("depth", "line", "nth")))["value"]
    won = hits.groupBy("path").agg(last("generated").alias("says_generated"), last("vendored").alias("says_vendored"))
    return paths.select("path").join(won, "path", "left")


def comment_runs(lines: list[str]):
    run = []
    for line in lines:
        m = _COMMENT.match(line)
        if m and not line.lstrip().startswith("#include"):
            run.append(m.group(1).strip("*/#!- "))
        elif run:
            yield " ".join(x for x in run if x)
            run = []
    if run:
        yield " ".join(x for x in run if x)


def head_comment(lines: list[str]) -> str:
    """The comment lines before the first line of code."""
    out, inside = [], False
    for line in lines:
        m = _COMMENT.match(line)
        if inside:
            out.append(line.strip().removesuffix("*/").strip("*/#!- "))
            inside = "*/" not in line
        elif m and not line.lstrip().startswith("#include"):
            out.append(m.group(1).strip("*/#!- "))
            inside = line.lstrip().startswith("/*") and "*/" not in line
        elif line.strip():
            break
    return "\n".join(out)


def block_evidence(text: str | None) -> tuple[int, int, int, bool, bool]:
    """chars, chars of minified lines, chars of data lines, generated header, vendored header."""
    if not text:
        return 0, 0, 0, False, False
    lines = text.splitlines()
    head = head_comment(lines)
    generated, vendored = (bool(_STANDALONE[k].search(head)) for k in ("generated", "vendored"))
    for c in comment_runs(lines):
        generated |= bool(_ORIGIN["generated"].search(c) or _CANONICAL.search(c))
        vendored |= bool(_ORIGIN["vendored"].search(c))
    chars = dense = data = 0
    for line in lines:
        s = line.strip()
        n = len(s)
        chars += n
        if n < 2:
            continue
        if n >= 120 and _ENCODED.match(s):
            data += n
            continue
        if s[0] in "/#*":
            if s.startswith(("//# sourceMappingURL=", "//@ sourceMappingURL=")):
                dense += 10**9
            continue
        rest = _LITERAL.sub("", s) if '"' in s or "'" in s or any(c.isdigit() for c in s) else s
        names = sum(map(len, _NAME.findall(rest)))
        if len(rest) < n and (names == 0 or (n >= 60 and names <= 0.2 * n and n - len(rest) >= 0.7 * n)):
            data += n
        elif n >= 150 and sum(s.count(c) for c in " \t") <= 0.07 * n and sum(s.count(c) for c in "(){}[];,=.!&|?:") >= 0.12 * n:
            dense += n
    return chars, dense, data, generated, vendored


def content_evidence(symbols: DataFrame, code_blocks: DataFrame, dense_share: float = 0.5, data_share: float = 0.5, least_data: int = 150) -> DataFrame:
    """`file_id, generated, vendored, minified, data` of each file that has blocks.

    The texts are read once, in a narrow pass; only figures are shuffled. A block
    counts once per id and content, however many rows repeat it.
    """

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([block_evidence(t) for t in pdf["content"]], columns=["chars", "dense", "literal", "generated", "vendored"])
            out.insert(0, "symbol_id", pdf["symbol_id"].astype("Int64"))
            out.insert(1, "block", pdf["block"])
            yield out

    texts = need(code_blocks, "id", "symbol_id", "content").where("symbol_id is not null").withColumn("block", F.xxhash64("id", "content"))
    figures = texts.mapInPandas(run, "symbol_id bigint, block bigint, chars bigint, dense bigint, literal bigint, generated boolean, vendored boolean").distinct()
    figures = figures.groupBy("symbol_id").agg(*(F.sum(c).alias(c) for c in ("chars", "dense", "literal")), *(F.max(c).alias(c) for c in ("generated", "vendored")))
    owner = need(symbols, "id", "file_id").where("id is not null and file_id is not null").distinct()
    per_file = figures.join(owner, F.col("symbol_id") == F.col("id")).groupBy("file_id").agg(*(F.sum(c).alias(c) for c in ("chars", "dense", "literal")), *(F.max(c).alias(c) for c in ("generated", "vendored")))
    return per_file.select(
        "file_id",
        "generated",
        "vendored",
        (F.col("dense") > dense_share * F.col("chars")).alias("minified"),
        ((F.col("literal") > data_share * F.col("chars")) & (F.col("literal") >= least_data)).alias("data"),
    )


def attribute_files(file_paths: DataFrame, symbols: DataFrame, code_blocks: DataFrame, name: str = ".gitattributes") -> DataFrame | None:
    """`dir, content` of the attribute files among the indexed files; None where no path has the name."""
    at = need(file_paths, "path", "file_id").where("file_id is not null").withColumn("u", F.regexp_replace("path", r"\\", "/")).where(F.col("u").endswith("/" + name)).select("file_id", F.regexp_replace("u", "/[^/]*$", "").alias("dir")).distinct()
    if at.isEmpty():
        return None
    owner = need(symbols, "id", "file_id").distinct().join(at, "file_id").select(F.col("id").alias("symbol_id"), "dir")
    text = need(code_blocks, "id", "symbol_id", "block_index", "content").where("content is not null").join(owner, "symbol_id").dropDuplicates(["dir", "id"])
    # an attribute file is a short list of lines
    return text.groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("symbol_id", "block_index", "content"))), lambda x: x["content"]), "\n").alias("content"))


def repository_depths(paths: DataFrame, attributes: DataFrame | None) -> DataFrame:
    """`unified, depth, declares`: how many leading directories of a path name its repository, and whether that has attribute files.

    The repository is the directory of the topmost attribute file above a path, where
    there is one; else the child of the first directory, from the top, that branches:
    directories with a single child only lead there.
    """
    parts = F.split("unified", "/")
    p = paths.select("unified").distinct().withColumn("parts", parts).where(F.size("parts") > 1)
    up = p.select("unified", F.size("parts").alias("n"), F.posexplode(F.slice("parts", 1, F.size("parts") - 1)).alias("at", "name"), "parts").select("unified", "n", (F.col("at") + 1).alias("depth"), F.array_join(F.slice("parts", 1, F.col("at") + 1), "/").alias("dir"), F.get("parts", F.col("at") + 1).alias("child"))
    forks = up.groupBy("dir").agg(F.min("child").alias("a"), F.max("child").alias("b")).where("a != b").select("dir")
    # nothing branches at a file: the repository has at least one directory
    found = up.join(forks, "dir").groupBy("unified").agg(F.least(F.min("depth") + 1, F.max("n") - 1).alias("depth"))
    if attributes is not None:
        own = up.join(attributes.select(unified(F.col("dir")).alias("dir")).distinct(), "dir").groupBy("unified").agg(F.min("depth").alias("own"))
        return found.join(own, "unified", "full_outer").select("unified", F.coalesce("own", "depth").alias("depth"), F.col("own").isNotNull().alias("declares"))
    return found.withColumn("declares", F.lit(False))


def path_shapes(path: Column, depth: Column) -> Column:
    """The directory names of a path below its repository, and its file-name shapes: what names have in common around the varying word."""
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(base, r"(\.[^.]+)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    tail = F.concat(F.lit("tail:"), F.regexp_extract(stem, r"([._-][A-Za-z0-9]+)$", 1), ext)
    head = F.concat(F.lit("head:"), F.regexp_extract(stem, r"^([A-Za-z0-9]+[._-])", 1), ext)
    below = F.slice(F.split(path, "/"), F.coalesce(depth, F.lit(0)) + 1, F.lit(1000))
    dirs = F.transform(F.filter(below, lambda x: ~x.contains(".")), lambda x: F.concat(F.lit("dir:"), x))
    return F.array_distinct(F.filter(F.concat(dirs, F.array(tail, head)), lambda x: ~x.rlike(r"^(?:tail|head):\.") & (x != "tail:") & (x != "head:")))


def mined_shapes(evidence: DataFrame, least_files: int = 12, least_roots: int = 5, purity: float = 0.95) -> DataFrame:
    """`shape`: path shapes that, over the whole collection, go with such files.

    evidence(file_id, root, unified, depth, shown, declares): `shown` is what the
    repository declares of the file, else what its contents show; `declares`: the
    repository has attribute files. A shape counts by its distinct files in at least
    `least_roots` repositories, of which at least `purity` are such; either over all
    repositories, or over those that declare.
    """
    shapes = evidence.select("file_id", "root", "shown", "declares", F.explode(path_shapes(F.col("unified"), F.col("depth"))).alias("shape")).distinct()
    per_root = shapes.groupBy("shape", "root").agg(F.count("*").alias("n"), F.sum(F.col("shown").cast("int")).alias("k"), F.max("declares").alias("declares"))
    those = lambda c: F.sum(F.when(F.col("declares"), F.col(c)).otherwise(0))
    sums = per_root.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.sum("k").alias("k"), those("n").alias("n2"), F.count(F.when(F.col("declares"), 1)).alias("roots2"), those("k").alias("k2"))
    enough = lambda n, roots, k: (F.col(n) >= least_files) & (F.col(roots) >= least_roots) & (F.col(k) >= purity * F.col(n))
    return sums.where(enough("n", "roots", "k") | enough("n2", "roots2", "k2")).select("shape")


def classify_paths(file_paths: DataFrame, symbols: DataFrame, code_blocks: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """One row per distinct path: `path, generated, vendored, minified, data, mined, by_attribute, foreign`.

    `foreign` is the verdict: not hand-written own source. What a repository's own
    attribute files say overrides other evidence, each attribute by itself: `-generated`
    clears what machines make (generated, minified, data), `-vendored` what is copied,
    and either a mined shape. `by_attribute` is true or false where attributes decided.
    A file's contents speak for all of its paths, and so does a default rule that one of
    its paths meets. Defined results: null paths are left out; a path without a usable
    file or blocks is judged by itself; several files under one path are all
    looked at; repeated rows count once; either slash style and drive letters are
    read alike; null and empty contents are no evidence.
    """
    paths = need(file_paths, "path", "file_id").where("path is not null").distinct().withColumn("unified", unified(F.col("path")))
    rules = parse_attributes(DEFAULT_ATTRIBUTES)
    paths = paths.withColumn("rule_generated", F.col("unified").rlike(_any(rules, "generated"))).withColumn("rule_vendored", F.col("unified").rlike(_any(rules, "vendored")))
    content = content_evidence(symbols, code_blocks)
    flags = ("generated", "vendored", "minified", "data")
    seen = paths.join(content, "file_id", "left")
    for c in flags:
        seen = seen.withColumn(c, F.coalesce(c, F.lit(False)))
    # the evidence of all paths of a file
    by_file = seen.groupBy("file_id").agg(*(F.max(c).alias(f"file_{c}") for c in ("rule_generated", "rule_vendored"))).where("file_id is not null")
    seen = seen.join(by_file, "file_id", "left")
    said = declared(paths.select("path", "unified").distinct(), attributes)
    if attributes is None:
        seen = seen.withColumns({"says_generated": F.lit(None).cast("boolean"), "says_vendored": F.lit(None).cast("boolean")})
    else:
        seen = seen.join(said, "path", "left")
    says = F.when(F.col("says_generated") | F.col("says_vendored"), True).when(F.col("says_generated").isNotNull() | F.col("says_vendored").isNotNull(), False)
    seen = seen.withColumn("shown", F.coalesce(says, F.col("generated") | F.col("vendored") | F.col("minified") | F.col("data")))
    seen = seen.join(repository_depths(paths, attributes), "unified", "left").withColumn("declares", F.coalesce("declares", F.lit(False))).withColumn("root", F.array_join(F.slice(F.split("unified", "/"), F.lit(1), F.coalesce("depth", F.lit(0))), "/"))
    mined = mined_shapes(seen.where("file_id is not null").select("file_id", "root", "unified", "depth", "shown", "declares"))
    # a shape is short and occurs in many repositories: the list is small, but the join doesn't rely on it
    by_shape = seen.select("path", F.explode(path_shapes(F.col("unified"), F.col("depth"))).alias("shape")).distinct().join(mined, "shape", "left_semi").select("path").distinct().withColumn("mined", F.lit(True))
    verdict = seen.groupBy("path").agg(
        F.max(F.col("generated") | F.coalesce("file_rule_generated", "rule_generated")).alias("generated"),
        F.max(F.col("vendored") | F.coalesce("file_rule_vendored", "rule_vendored")).alias("vendored"),
        F.max("minified").alias("minified"),
        F.max("data").alias("data"),
        *(F.max(c).alias(c) for c in ("says_generated", "says_vendored")),
    )
    out = verdict.join(by_shape, "path", "left").withColumn("mined", F.coalesce("mined", F.lit(False)))
    made = F.coalesce("says_generated", F.col("generated") | F.col("minified") | F.col("data"))
    copied = F.coalesce("says_vendored", F.col("vendored"))
    by_shape = F.col("mined") & F.coalesce("says_generated", F.lit(True)) & F.coalesce("says_vendored", F.lit(True))
    out = out.withColumn("foreign", made | copied | by_shape)
    return out.withColumn("by_attribute", F.when(F.col("says_generated").isNotNull() | F.col("says_vendored").isNotNull(), F.col("foreign"))).drop("says_generated", "says_vendored")
