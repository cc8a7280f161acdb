"""Symbols and calls out of source files: Python by its syntax tree, other languages by a small lexer.

`extract_symbols` runs as one Arrow-batched pass over a scan. Comments and strings
are blanked first, so that declarations are only found in code; bodies end with
their brackets, or with their indentation in Python.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: File extensions and their languages.
LANGUAGES = {
    "py": "py", "go": "go", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "cs", "hlsl": "shader", "fx": "shader", "fxh": "shader", "hlsli": "shader", "glsl": "shader", "vert": "shader", "frag": "shader", "geom": "shader", "comp": "shader", "tese": "shader", "tesc": "shader",
}
SCHEMA = "path string, name string, kind string, line int, end_line int, params string, param_count int, nesting_depth int, snippet string, description string, tags map<string,string>, calls array<string>"


@dataclass
class Found:
    name: str
    kind: str
    line: int
    end_line: int
    snippet: str = ""
    params: str = ""
    depth: int = 0
    description: str | None = None
    tags: dict[str, str] = field(default_factory=dict)
    calls: list[str] = field(default_factory=list)


EXTRACTORS: dict[str, Callable[[str, str], list[Found]]] = {}


def extractor(*languages: str):
    """Register an extractor(path, text) for languages or base names."""

    def register(f):
        EXTRACTORS.update(dict.fromkeys(languages, f))
        return f

    return register


def count_params(params: str) -> int:
    """Commas outside of brackets, plus one; a blank list has none."""
    if not params.strip():
        return 0
    depth = n = 0
    for c in params:
        depth += (c in "([{<") - (c in ")]}>")
        n += c == "," and depth == 0
    return n + 1


def settle_calls(found: list[Found], sites: dict[int, list[tuple[str, str]]], receivers: dict[int, tuple[str, str]], fields: dict[tuple[str, str], str]) -> list[Found]:
    """Give each function its callees' full names, as far as the file shows them.

    sites: per function (by its place in `found`) the (object, name) of its calls. In
    order: an object whose declared type is known; the receiver of a Go method, or
    `self` and `this`; a bare name of the own class; the only symbol of the file with
    that short name; else the name as it is written. A function isn't its own callee.
    """
    known = {f.name for f in found}
    by_short: dict[str, set[str]] = {}
    for f in found:
        if f.kind in ("function", "method"):
            by_short.setdefault(f.name.rsplit(".", 1)[-1], set()).add(f.name)

    def full(i: int, obj: str, short: str) -> str:
        own = found[i].name.rpartition(".")[0]
        if obj:
            declared = fields.get((own.rsplit(".", 1)[-1], obj))
            if declared:
                return next(iter(sorted(n for n in by_short.get(short, ()) if f".{n}".endswith(f".{declared}.{short}"))), f"{declared}.{short}")
            var, kind = receivers.get(i, ("", ""))
            if obj in ("self", "this") or (var and obj == var):
                own_name = f"{kind or own}.{short}"
                if own_name in known:
                    return own_name
        elif own and f"{own}.{short}" in known:
            return f"{own}.{short}"
        same = by_short.get(short, set())
        return next(iter(same)) if len(same) == 1 else short

    for i, calls in sites.items():
        found[i].calls = sorted({full(i, o, c) for o, c in calls} - {found[i].name})
    return found


def parameters(text: str) -> str:
    """What stands in the first round brackets of a declaration, white space as single blanks."""
    at = text.find("(")
    depth, i, quote = 0, at, ""
    while 0 <= i < len(text):
        c = text[i]
        if quote:
            if text.startswith(quote, i):
                i, quote = i + len(quote) - 1, ""
            elif c == "\\":
                i += 1
        elif c in "\"'":
            quote = c * 3 if text.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return " ".join(text[at + 1 : i].split())
        i += 1
    return ""


@extractor("py")
def python_symbols(path: str, text: str) -> list[Found]:
    """Names are prefixed by the module, which is the file's base name, and by the classes around them."""
    tree = ast.parse(text)
    lines = text.split("\n")
    module = re.sub(r"\.py$", "", path.replace("\\", "/").rsplit("/", 1)[-1])
    out: list[Found] = []
    sites: dict[int, list[tuple[str, str]]] = {}

    def calls(node):
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name):
                    yield "", f.id
                elif isinstance(f, ast.Attribute):
                    yield (f.value.id if isinstance(f.value, ast.Name) else "?"), f.attr

    def source(n):
        """The node's own text, without decorators."""
        return "\n".join(lines[n.lineno - 1 : n.end_lineno])[len(lines[n.lineno - 1].encode()[: n.col_offset].decode()) :]

    def visible(name):
        return "private" if name.startswith("_") else "public"

    def visit(body, classes, depth, holds, in_function):
        """holds: `module`, `class` or nothing: whose assignments are variables, and whose functions methods."""
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(n, ast.ClassDef)
                tags = {"namespace": module, "visibility": visible(n.name)}
                text = source(n)
                out.append(Found(".".join([module, *classes, n.name]), "class" if is_class else "method" if holds == "class" else "function", n.lineno, n.end_lineno, text, "" if is_class else parameters(text), depth, None, tags))
                if not is_class and not in_function:  # calls of nested functions are the outermost one's
                    sites[len(out) - 1] = list(calls(n))
                visit(n.body, [*classes, n.name] if is_class else classes, depth + 1, "class" if is_class else "", in_function or not is_class)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)) and holds:
                t = n.targets[0] if isinstance(n, ast.Assign) else n.target
                if isinstance(t, ast.Name):
                    out.append(Found(".".join([module, *classes, t.id]), "variable", n.lineno, n.end_lineno, source(n), depth=depth, tags={"namespace": module, "visibility": visible(t.id)}))
            else:
                parts = [getattr(n, f, []) for f in ("body", "orelse", "finalbody")] + [h.body for h in getattr(n, "handlers", [])] + [c.body for c in getattr(n, "cases", [])]
                for inner in parts:
                    if isinstance(inner, list):
                        visit(inner, classes, depth, "", in_function)

    visit(tree.body, [], 0, "module", False)
    return settle_calls(out, sites, {}, {})


_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`", re.S)
_WORDS = {"if", "for", "while", "switch", "return", "catch", "else", "do", "sizeof", "new", "using", "lock", "foreach", "function", "func", "throw", "await", "typeof", "delete", "case"}
_ARGS = r"\((?P<params>[^(){};]*(?:\([^(){};]*\)[^(){};]*)*)\)"
_MODS = r"(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|const|virtual|override|async|extern|unsafe|new|volatile|required)\s+)*"
_TYPE = r"(?!(?:return|new|await|throw|else|yield|goto|using|namespace|class|struct|interface|enum|case|var|delegate|event)\b)[A-Za-z_][\w.]*(?:\s*<[^;=(){}]*>)?[\w\[\],.?]*"
#: Declarations per language family: (pattern, kind); the name is the group `name`.
_DECLARATIONS = {
    "go": [(rf"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*{_ARGS}[^{{\n]*\{{", "function"), (r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\s*\{", "type"), (r"^type\s+(?P<name>\w+)\s+\w", "type"), (r"^(?:var|const)\s+(?P<name>\w+)", "variable")],
    "js": [(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+(?P<name>[\w$]+)\s*{_ARGS}[^{{;\n]*\{{", "function"), (r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)[^{;]*\{", "class"), (rf"^[ \t]+(?:(?:public|private|protected|static|async|get|set)\s+)*(?P<name>[\w$]+)\s*{_ARGS}[^{{;\n=]*\{{", "method"), (r"^(?:const|let|var)\s+(?P<name>[\w$]+)", "variable")],
    "c": [(rf"^(?!\s*(?:typedef|return)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&](?P<name>[\w:~]+)\s*{_ARGS}[^{{;]*\{{", "function"), (r"^[ \t]*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{", "struct"), (r"^(?!(?:typedef|return|using|goto|else|case)\b)(?:[A-Za-z_][\w:<>,]*\s+)+(?P<name>\w+)\s*=(?!=)[^;]*;", "variable")],
    "cs": [
        (r"^[ \t]*namespace\s+(?P<name>[\w.]+)\s*[{;]", "namespace"),
        *((rf"^[ \t]*{_MODS}{kind}\s+(?P<name>\w+)[^{{;]*\{{", kind) for kind in ("class", "struct", "interface", "enum")),
        (rf"^[ \t]*{_MODS}{_TYPE}\s+(?P<name>\w+)\s*(?:<[^>(]*>)?\s*{_ARGS}\s*(?:where\b[^{{;]*)?(?:\{{|;|=>)", "method"),
        (rf"^[ \t]*{_MODS}(?P<name>\w+)\s*{_ARGS}\s*(?::\s*(?:base|this)\s*\([^{{}};]*\))?\s*\{{", "constructor"),
        (rf"^[ \t]*{_MODS}{_TYPE}\s+(?P<name>\w+)\s*(?:\{{(?=\s*(?:(?:public|private|protected|internal)\s+)?(?:get|set|init)\b)|=>)", "field"),
        (rf"^[ \t]*{_MODS}{_TYPE}\s+(?P<name>\w+)\s*(?:=(?![>=])[^;]*)?;", "field"),
    ],
}
_DECLARATIONS["cpp"] = [(r"^[ \t]*namespace\s+(?P<name>[\w:]+)\s*\{", "namespace"), *_DECLARATIONS["c"], (r"^[ \t]*class\s+(?P<name>\w+)[^{;]*\{", "class")]
_DECLARATIONS["shader"] = _DECLARATIONS["c"][:2]
#: Kinds that give their name to what they hold, and all that count for the depth.
_NAMING, _HOLDING = ("class", "struct", "interface"), ("class", "struct", "interface", "function", "method")
_COMPILED = {k: [(re.compile(p, re.M), kind) for p, kind in v] for k, v in _DECLARATIONS.items()}
_CALL = re.compile(r"(?:\b([A-Za-z_$][\w$]*)\s*(?:\.|->|::)\s*)?\b([A-Za-z_$][\w$]*)\s*\(")
_FIELD = re.compile(r"^[ \t]+(?:(?:public|private|protected|internal|readonly|static|const)\s+)*([A-Z]\w*)(?:<[^;=\n]*>)?\s*[*&]?\s+[*&]?(\w+)\s*[;=]", re.M)
_RECEIVER = re.compile(r"^func\s+\(\s*(\w+)\s")


def _blank(text: str) -> str:
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _closing(code: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(code)


def lexed_symbols(path: str, text: str, lang: str) -> list[Found]:
    code = _blank(text)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda p: bisect.bisect_right(starts, p)
    spans: dict[int, tuple[int, str, str, str, str]] = {}
    for rx, kind in _COMPILED[lang]:
        for m in rx.finditer(code):
            name = m["name"]
            if name in _WORDS:
                continue
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            owner = (m.groupdict().get("owner") or "") if lang == "go" else ""
            if m[0].endswith("{"):
                end = _closing(code, m.end() - 1)
            elif m[0].endswith(";"):
                end = m.end()
            else:
                stop = code.find(";" if m[0].endswith("=>") else "\n", m.end())
                end = stop + m[0].endswith("=>") if stop >= 0 else len(code)
            spans.setdefault(line(at), (at, end, "method" if owner else kind, f"{owner}.{name}" if owner else name, " ".join((m.groupdict().get("params") or "").split()), text[at : m.end()]))
    if lang == "go":  # grouped constants and variables
        for m in re.finditer(r"^(?:const|var)\s*\((.*?)^\)", code, re.M | re.S):
            for x in re.finditer(r"^[ \t]+(\w+)[^\n]*", m[1], re.M):
                at = m.start(1) + x.start(1)
                spans.setdefault(line(at), (at, m.start(1) + x.end(), "variable", x[1], "", x[1]))
    package = re.search(r"^package\s+(\w+)", code, re.M) if lang == "go" else None
    out: list[Found] = []
    open_: list[tuple[int, str, str]] = []
    deep: list[int] = []
    sites, receivers, fields = {}, {}, {}
    for ln in sorted(spans):
        at, end, kind, name, params, head = spans[ln]
        while open_ and open_[-1][0] <= at:
            open_.pop()
        spaces = [n.replace("::", ".") for _, n, k in open_ if k == "namespace"] or ([package[1]] if package else [])
        if kind == "namespace":
            block = code[at:end].rstrip().endswith("}")
            open_.append((end if block else len(code), name, kind))
            deep += [end] if block and lang == "cs" else []  # a namespace in brackets counts for the depth in C#
            continue
        inner = open_[-1][2] if open_ else ""
        holders = [n for _, n, k in open_ if k in _NAMING]
        if kind == "constructor":
            if not holders or name != holders[-1]:
                continue
            kind = "method"
        if (lang == "cs" and kind in ("method", "field") and inner not in _NAMING) or (kind == "variable" and inner):
            continue  # a statement of a body
        tags = {"namespace": ".".join(spaces)} if spaces else {}
        if lang == "cs":
            words = re.findall(r"\b(?:public|private|protected|internal|static)\b", re.split(r"[(=;{]", head)[0])
            if "static" in words:
                tags["is_static"] = "true"
            shown = [w for w in dict.fromkeys(words) if w != "static"]
            if shown:
                tags["visibility"] = " ".join(shown)
        if lang == "go":
            tags["visibility"] = "public" if name.split(".")[-1][:1].isupper() else "private"
        out.append(Found(".".join([*spaces, *holders, name]), kind, ln, line(max(at, end - 1)), text[at:end], params, sum(k in _HOLDING for *_, k in open_) + sum(d > at for d in deep), None, tags))
        if kind in ("function", "method") and not any(k in ("function", "method") for *_, k in open_):
            sites[len(out) - 1] = [(o or "", c) for o, c in _CALL.findall(re.split(r"\{|=>", code[at:end], maxsplit=1)[-1] if re.search(r"\{|=>", code[at:end]) else "") if c not in _WORDS]
            m = _RECEIVER.match(head)
            if m:
                receivers[len(out) - 1] = (m[1], out[-1].name.rpartition(".")[0])
        if kind in ("class", "struct"):
            fields |= {(name, f): t for t, f in _FIELD.findall(code[at:end]) if t not in _WORDS}
        if kind in (*_HOLDING, "enum"):
            open_.append((end, name, kind))
    return settle_calls(out, sites, receivers, fields)


for _lang in _COMPILED:
    EXTRACTORS[_lang] = lambda p, t, _l=_lang: lexed_symbols(p, t, _l)


@extractor("package.json")
def package_symbols(path: str, text: str) -> list[Found]:
    """One `package` symbol: its shown name, its description and keywords."""
    data = json.loads(text)
    name = data.get("displayName") or data.get("name") or ""
    if not name:
        return []
    words = ", ".join(map(str, data.get("keywords") or []))
    about = data.get("description") or ""
    parts = [f"package: {data.get('name', name)}", about, f"keywords: {words}" if words else ""]
    return [Found(name, "package", 1, 1, "\n".join(p for p in parts if p), description=about or None)]


@extractor("yaml", "yml")
def yaml_symbols(path: str, text: str) -> list[Found]:
    """Top-level keys: a mapping with a name is a `job`, anything else a `config-key` with a short value."""
    import yaml

    data = yaml.safe_load(text)
    out = []
    for key, value in data.items() if isinstance(data, dict) else ():
        if isinstance(value, dict) and "name" in value:
            deps = value.get("dependencies")
            out.append(Found(str(value["name"]), "job", 1, 1, f"{key}: {value['name']}" + (f"\ndependencies: {deps}" if deps is not None else "")))
        else:
            shown = str(value)
            out.append(Found(str(key), "config-key", 1, 1, f"{key}: {shown[:80] + '...' if len(shown) > 80 else shown}"))
    return out


def extract(path: str, content: bytes | None) -> list[Found]:
    """The symbols of one file; none where the language is unknown or the file broken."""
    base = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    ext = base.rsplit(".", 1)[-1] if "." in base else ""
    run = EXTRACTORS.get(base) or EXTRACTORS.get(LANGUAGES.get(ext, ext))
    if run is None or content is None:
        return []
    try:
        return run(path, bytes(content).decode("utf-8", "replace"))
    except Exception:  # noqa: BLE001 - a broken file has no symbols
        return []


def packages(files: DataFrame) -> DataFrame:
    """`path, package`: the dotted package of each Python file: its directories, from the outermost of an unbroken row that have an `__init__.py`."""
    parts = F.split(F.replace("path", F.lit("\\"), F.lit("/")), "/")
    p = files.select("path", parts.alias("parts")).where(F.col("path").endswith(".py") & (F.size("parts") > 1))
    dirs = p.where(F.element_at("parts", -1) == "__init__.py").select(F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("dir")).distinct().withColumn("held", F.lit(True))
    up = p.select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k")).withColumn("dir", F.array_join(F.slice("parts", 1, F.col("k")), "/"))
    last = up.join(dirs, "dir", "left").groupBy("path", "parts").agg(F.coalesce(F.max(F.when(F.col("held").isNull(), F.col("k"))), F.lit(0)).alias("outside"))
    return last.select("path", F.array_join(F.slice("parts", F.col("outside") + 1, F.size("parts") - 1 - F.col("outside")), ".").alias("package")).where("package != ''")


def in_package(found: list[Found], package: str | None) -> list[Found]:
    """Symbols of a Python file with their package in front of the module's name."""
    if package and found:
        module = found[0].tags.get("namespace", "")
        for f in found:
            f.name, f.tags = f"{package}.{f.name}", f.tags | {"namespace": f"{package}.{module}"}
            f.calls = sorted(f"{package}.{c}" if c.startswith(module + ".") else c for c in f.calls)
    return found


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols (SCHEMA) of files(path, content binary)."""
    columns = [c.strip().split(" ")[0] for c in re.sub(r"map<string,string>", "map", SCHEMA).split(",")]

    def run(batches):
        for pdf in batches:
            rows = [(p, s.name, s.kind, s.line, s.end_line, s.params, count_params(s.params), s.depth, s.snippet, s.description, s.tags, s.calls) for p, c, k in zip(pdf["path"], pdf["content"], pdf["package"]) for s in in_package(extract(p, c), k)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").join(packages(files), "path", "left").mapInPandas(run, SCHEMA)
