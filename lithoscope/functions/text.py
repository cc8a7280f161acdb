"""Column functions on strings, paths and durations."""

from __future__ import annotations

import os

from pyspark.sql import Column, functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(s: ColumnOrName) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_c(s)), r"\s+", " "))


def strip(s: ColumnOrName) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(_c(s), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normhash(s: ColumnOrName) -> Column:
    """Hash of a text up to letter case and white space."""
    return F.sha2(collapse(s), 256)


def content_hash(s: ColumnOrName) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(_c(s), 256), 1, 16)


def truncate(s: ColumnOrName, n: int) -> Column:
    """At most n characters, the last three of them dots where something was cut."""
    s = _c(s)
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, max(n - 3, 0)), F.lit("...")))


def like(s: ColumnOrName, pattern: str) -> Column:
    """LIKE without regard to case, where % and _ are wildcards and nothing is an escape."""
    return F.ilike(_c(s), F.lit(pattern.replace("\\", "\\\\")))


def slashes(path: ColumnOrName) -> Column:
    return F.replace(_c(path), F.lit("\\"), F.lit("/"))


def normalize_dir(path: str) -> str:
    """A directory as filters take it: the resolved path where it exists on this machine, else as given; forward slashes."""
    real = os.path.realpath(path) if path else ""
    return (real if path and os.path.exists(real) else path).replace("\\", "/")


def under(path: ColumnOrName, directory: str) -> Column:
    """Whether a path holds a directory, in either slash style, as one of its parts or at its end (LIKE wildcards count)."""
    out = None
    for sep, other in (("/", "\\"), ("\\", "/")):
        d = directory.replace(other, sep).rstrip(sep)
        hit = like(path, f"%{d}{sep}%") | like(path, f"%{d}")
        out = hit if out is None else out | hit
    return out


def dirname(path: ColumnOrName) -> Column:
    """Everything in front of the last slash; empty where there is none."""
    return F.when(slashes(path).contains("/"), F.regexp_replace(slashes(path), r"/[^/]*$", "")).otherwise("")


def basename(path: ColumnOrName) -> Column:
    return F.regexp_extract(slashes(path), r"([^/]*)$", 1)


def extension(path: ColumnOrName) -> Column:
    """Lower-case extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def strip_prefix(path: ColumnOrName, directory: str) -> Column:
    """The path relative to a directory, unchanged outside of it."""
    p, front = slashes(path), directory.replace("\\", "/").rstrip("/") + "/"
    return F.when(p.startswith(front), F.substring(p, len(front) + 1, 1 << 30)).otherwise(p)


def module_of(path: ColumnOrName, namespace: ColumnOrName) -> Column:
    """The unit of dependency: the namespace in C#, the directory in Go, else the file."""
    p = slashes(path)
    return F.when(p.endswith(".cs"), F.coalesce(_c(namespace), p)).when(p.endswith(".go") & p.contains("/"), F.regexp_replace(p, r"/[^/]*$", "")).otherwise(p)


def count_params(params: ColumnOrName) -> Column:
    """Parameters of a list: commas outside of brackets, plus one; a blank list has none.

    Bracketed parts are removed from the inside out, eight levels deep.
    """
    flat = _c(params)
    for _ in range(8):
        flat = F.regexp_replace(flat, r"\([^()\[\]{}<>]*\)|\[[^()\[\]{}<>]*\]|\{[^()\[\]{}<>]*\}|<[^()\[\]{}<>]*>", "")
    commas = F.char_length(flat) - F.char_length(F.replace(flat, F.lit(","), F.lit("")))
    return F.when(F.coalesce(F.trim(_c(params)), F.lit("")) == "", F.lit(0)).otherwise(commas + 1)


def parse_branch(refs: ColumnOrName) -> Column:
    """The branch among the decorations of a commit: what HEAD points at, else the first local one."""
    parts = F.transform(F.split(_c(refs), ","), lambda x: F.trim(x))
    head = F.try_element_at(F.filter(parts, lambda x: x.startswith("HEAD -> ")), F.lit(1))
    local = F.try_element_at(F.filter(parts, lambda x: (x != "") & (x != "HEAD") & ~x.startswith("origin/")), F.lit(1))
    return F.coalesce(F.substring(head, 9, 1 << 20), local, F.lit(""))


def neutral_braces(s: ColumnOrName) -> Column:
    return F.translate(_c(s), "{}", "()")


def glob_directory(pattern: ColumnOrName) -> Column:
    """The directory in front of the first wildcard of a glob."""
    front = F.regexp_replace(F.regexp_replace(_c(pattern), r"[*?\[].*$", ""), r"/+$", "")
    return F.when(front == "", F.lit(".")).otherwise(front)


def glob_regex(pattern: ColumnOrName, anywhere: bool = True) -> Column:
    """A shell glob as a regular expression; `anywhere`: may begin behind any slash of the path."""
    quoted = F.regexp_replace(_c(pattern), r"([.+^$(){}|\\])", r"\\$1")
    rx = F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    return F.concat(F.lit("^(?:.*/)?" if anywhere else "^"), rx, F.lit("$"))


def format_eta(seconds: ColumnOrName) -> Column:
    """Seconds as whole s, m, h or d."""
    s = _c(seconds).cast("bigint")
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def format_age(seconds: ColumnOrName) -> Column:
    days = F.floor(_c(seconds) / 86400)
    return F.when(days < 1, F.lit("today")).otherwise(F.concat(days.cast("string"), F.lit("d old")))


def rrf(rank: ColumnOrName, k: int = 60) -> Column:
    """Reciprocal-rank weight of a 0-based rank."""
    return F.lit(1.0) / (F.lit(k) + _c(rank) + 1)


def fixed(x: ColumnOrName, digits: int, width: int = 0) -> Column:
    """A number with so many digits, as C prints it: numbers that lie exactly between two go to the even one."""
    x = _c(x)
    exact = x * 65536 == F.floor(x * 65536)
    return F.format_string(f"%{width or ''}.{digits}f", F.when(exact, F.bround(x, digits)).otherwise(x))


def first_json(text: ColumnOrName, kind: str = "array") -> Column:
    """The widest JSON array (or object) in a model's answer, without code fences."""
    bare = F.regexp_replace(F.trim(_c(text)), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.regexp_extract(bare, r"(?s)(\[.*\])" if kind == "array" else r"(?s)(\{.*\})", 1)
