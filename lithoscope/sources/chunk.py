"""Blocks of symbols, and the context of a symbol in its file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lithoscope.functions.text import content_hash
from lithoscope.sources.extract import _HOLDING, extract

#: The lines around a symbol in its context, and in place of what is left out.
START, END, STRIPPED = "===== DESCRIBE THIS SYMBOL =====", "===== END SYMBOL =====", "    // ..."


def cut_points(text: str, max_chars: int, path: str = "") -> list[int]:
    """Line numbers (from 0) before which a text is cut.

    In front of declarations inside of it, where the path tells a language that has such;
    else behind each line with which a block has reached `max_chars` and two lines.
    """
    nested = sorted({s.line - 1 for s in extract(path, text.encode("utf-8", "replace")) if s.kind in _HOLDING and s.line > 1}) if path else []
    if nested:
        return nested
    out, first, size = [], 0, 0
    for i, x in enumerate(text.split("\n")):
        size += len(x) + 1
        if size >= max_chars and i > first:
            out.append(i + 1)
            first, size = i + 1, 0
    return out


def blocks_of(content: str | None, start: int, end: int, max_chars: int, path: str = "") -> list[tuple[int, str, int, int]]:
    """`index, content, first line, last line` of a symbol's blocks; one block where it fits or can't be cut."""
    text = content or ""
    whole = [(0, text, start, end)]
    if max_chars <= 0 or len(text) <= max_chars:
        return whole
    lines = text.split("\n")
    edges = [0, *cut_points(text, max_chars, path), len(lines)]
    parts = [(a, b) for a, b in zip(edges, edges[1:]) if "\n".join(lines[a:b]).strip()]
    if len(parts) < 2:
        return whole
    return [(k, "\n".join(lines[a:b]), start + a, end if b == len(lines) else start + b - 1) for k, (a, b) in enumerate(parts)]


def chunk_symbols(symbols: DataFrame, max_chars: int = 2000) -> DataFrame:
    """`symbol_id, block_index, content, content_hash, start_line, end_line` of symbols(id, snippet, line, end_line[, path]).

    With a path, its language's declarations inside of a symbol are where it is cut.
    """

    def run(batches):
        for pdf in batches:
            rows = [(i, *b) for i, s, a, e, p in pdf.itertuples(index=False) for b in blocks_of(s, int(a), int(e), max_chars, p)]
            yield pd.DataFrame(rows, columns=["symbol_id", "block_index", "content", "start_line", "end_line"])

    src = symbols.select("id", "snippet", F.coalesce("line", F.lit(1)).alias("line"), F.coalesce("end_line", "line", F.lit(1)).alias("end_line"), (F.coalesce("path", F.lit("")) if "path" in symbols.columns else F.lit("")).alias("path"))
    return src.mapInPandas(run, "symbol_id bigint, block_index int, content string, start_line int, end_line int").withColumn("content_hash", content_hash("content"))


def with_context(text: str, first: int, last: int, others: list[tuple[int, int]], max_chars: int) -> str:
    """A file's text with marks around lines first..last; above `max_chars` the bodies of other symbols are left out.

    A symbol that holds the target keeps its body.
    """
    lines = text.split("\n")
    hidden = set()
    if len(text.encode("utf-8", "replace")) > max_chars:
        for a, b in others:
            if a != first and not (a <= first and b >= last):
                hidden.update(range(a + 1, b + 1))
    out = []
    for n, x in enumerate(lines, 1):
        if n == first:
            out.append(START)
        if n not in hidden:
            out.append(x)
        elif n - 1 not in hidden or n == 1:
            out.append(STRIPPED)
        if n == last:
            out.append(END)
    return "\n".join(out)


def embed_halving(embed, text: str, most: int = 20):
    """A vector of a text that may be too long for the model: halved until the model takes it."""
    for _ in range(most):
        try:
            return embed(text)
        except ValueError as e:
            if "context length" not in str(e) or len(text) < 2:
                raise
            text = text[: len(text) // 2]
    raise ValueError("the model takes no part of the text")
