"""Problem 5: cutting oversized texts at natural boundaries, by byte ranges.

A text is a sequence of byte ranges, of a file or of a row's string. Workers look for
boundaries within a range, with a halo on either side so that a boundary is judged by
what surrounds it. Between ranges the cut is at an anchor, the best boundary at the
beginning of a range: it is worked out from the same few bytes by the workers of both
sides, so that all ranges are cut at once. The ranges' tables are stitched by prefix
sums of their characters, lines and pieces, and the pieces come out by offset.

No step holds a whole file: `split_files` reads one range with its halo at a time. A
row's string is in memory anyway; its ranges are cut one after the other, and only
pieces leave the task.

Limits and offsets count Unicode code points. A byte that isn't UTF-8 is one of them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lithoscope.session import materialise, need

#: Kinds of boundaries, better ones first: after a blank line, before a line without
#: indentation, before any line, after a sentence, after a blank, anywhere.
BLANK_LINE, TOP_LEVEL, LINE, SENTENCE, SPACE = 5, 4, 3, 2, 1
_SENTENCE = re.compile(r"[.!?。！？][\"')\]]*\s+|[;,}\])]\s*(?=\S)")
_SPACE = re.compile(r"\s+")
HALO = 64
#: Bytes of a range. A text's pieces depend on it where the text is longer.
RANGE_BYTES = 1 << 20


def boundaries(before: str, body: str, after: str) -> list[tuple[int, int]]:
    """(place in body, kind) of the cuts in front of characters of `body`; halos only inform."""
    text, lo = before + body + after, len(before)
    hi = lo + len(body)
    best: dict[int, int] = {}
    at, line = text.find("\n"), 0 if not before else -1  # where the line begins, if that is in sight
    while at >= 0:
        p = at + 1
        if lo <= p < hi:
            nxt = text[p : p + 1]
            if line >= 0 and not text[line:at].strip(" \t\r"):
                best[p] = BLANK_LINE
            elif nxt and nxt not in " \t\r\n})]":
                best[p] = TOP_LEVEL
            else:
                best[p] = LINE
        at, line = text.find("\n", p), p
    for rx, kind in ((_SENTENCE, SENTENCE), (_SPACE, SPACE)):
        for m in rx.finditer(text):
            p = m.end()
            if lo <= p < hi and best.get(p, 0) < kind:
                best[p] = kind
    return sorted((p - lo, k) for p, k in best.items())


def choose_cuts(places: np.ndarray, kinds: np.ndarray, first: int, total: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of the characters first..total, from a boundary table.

    Each piece ends at the best kind of boundary in the second half of what it may
    hold, the last such. All but a text's very first piece start up to `overlap`
    characters before the end of the one before, at the first line start there, else at
    the first lesser boundary, else at that end.
    """

    def back(end: int, least: int) -> int:
        lo, hi = np.searchsorted(places, [max(end - overlap, least), end])
        lines = np.flatnonzero(kinds[lo:hi] >= LINE)
        if len(lines):
            return int(places[lo + lines[0]])
        return int(places[lo]) if lo < hi else end

    out, start, done = [], back(first, 0), first
    while total - start > limit:
        lo, hi = np.searchsorted(places, [max(done + 1, start + limit // 2), start + limit + 1])
        if lo == hi:
            lo = np.searchsorted(places, done + 1)
        if lo < hi:
            k = kinds[lo:hi]
            end = int(places[lo + np.flatnonzero(k == k.max())[-1]])
        else:
            end = start + limit
        out.append((start, end))
        done, start = end, back(end, start + 1)
    out.append((start, total))
    return out


def _aligned(raw: bytes, at: int) -> int:
    """The first place from `at` on that isn't inside a character."""
    for k in range(4):
        if at + k >= len(raw) or raw[at + k] & 0xC0 != 0x80:
            return min(at + k, len(raw))
    return at


def _decode(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


class Ranges:
    """The byte ranges of one text: read(offset, length) gives bytes, `size` is their number."""

    def __init__(self, read, size: int, limit: int, overlap: int, range_bytes: int):
        self.read, self.size, self.limit, self.overlap = read, size, limit, overlap
        self.bytes = max(range_bytes, 16 * limit)
        self.count = max(1, -(-size // self.bytes))

    def window(self, k: int, back: int, ahead: int, own: int | None = None) -> tuple[str, str, str]:
        """What is in front of range k (`back` characters or more), the range (or its first `own` bytes), and what follows (`ahead` or more)."""
        lo, hi = k * self.bytes, min(self.size, k * self.bytes + (self.bytes if own is None else own))
        a, b = max(0, lo - 4 * back - 4), min(self.size, hi + 4 * ahead + 4)
        raw = self.read(a, b - a)
        stop = len(raw)
        if b < self.size:  # not a part of a character at the end
            while stop and raw[stop - 1] & 0xC0 == 0x80 and len(raw) - stop < 3:
                stop -= 1
            stop -= stop > 0 and raw[stop - 1] >= 0xC0
        cut = [_aligned(raw, 0) if a else 0, _aligned(raw, lo - a) if lo else 0, _aligned(raw, hi - a) if b < self.size or hi < self.size else len(raw), stop]
        return tuple(_decode(raw[x : max(x, y)]) for x, y in zip(cut, cut[1:]))

    def anchor(self, k: int) -> int:
        """Characters of range k in front of its anchor: the first of the best boundaries at its beginning."""
        if k == 0:
            return 0
        before, body, after = self.window(k, HALO, HALO, 4 * self.limit)
        body, after = body[: self.limit], (body[self.limit :] + after)[:HALO]
        table = boundaries(before[-HALO:], body, after)
        best = max((kind for _, kind in table), default=0)
        return next((p for p, kind in table if kind == best), 0)

    def pieces(self, k: int) -> tuple[int, int, list[tuple[int, int, int, str]]]:
        """Characters and line ends of range k, and its pieces: start and end, counted from the range's first character, line ends in front, text."""
        before, own, after = self.window(k, self.overlap + HALO, self.limit + HALO)
        text, lo = before + own + after, len(before)
        hi = lo + len(own)
        first = lo + self.anchor(k)
        total = len(text) if k + 1 == self.count else hi + self.anchor(k + 1)
        head = max(0, lo - self.overlap)
        table = thin(boundaries(text[:head], text[head:total], text[total : total + HALO]), max(1, self.overlap // 4))
        places, kinds = (np.array([x[j] for x in table], np.int64) for j in (0, 1))
        cuts = choose_cuts(places + head, kinds, first, total, self.limit, self.overlap)
        out, at, lines = [], lo, 0
        for start, end in cuts:
            lines += text.count("\n", at, start) if start >= at else -text.count("\n", start, at)
            at = start
            out.append((start - lo, end - lo, lines, text[start:end]))
        return len(own), own.count("\n"), out


def thin(table: list[tuple[int, int]], step: int) -> list[tuple[int, int]]:
    """A table with all lines, and of the lesser kinds the last place per `step` characters."""
    keep = {(p // step, k) if k < LINE else (p, k): (p, k) for p, k in table}
    return sorted(keep.values())


def _plain(text: str) -> str:
    return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


PIECES = "id bigint, block_index int, content string, start_line int, start_char bigint, end_char bigint, source_hash string"


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")


def split_oversized(blocks: DataFrame, limit: int = 2000, overlap: int = 200, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The pieces of all texts longer than `limit` code points (columns: PIECES).

    blocks(id, content, start_line). `block_index` counts a text's pieces from 0;
    `start_line` is the line of the file on which the piece starts (of the text
    from 1 where the row has none); `source_hash` is that of the whole text. Each piece
    has at most `limit` characters and repeats at most `overlap` of the piece before,
    whole lines where there are any; without the repeated part the pieces are the text.

    Defined results: null and short texts give no pieces; repeated rows give one
    set of pieces (a null start line is line 1); rows of one id and different texts
    are split separately, and so are those of null ids; a text without any boundary
    is cut at the limit; other columns are ignored. Texts are cut where they are read;
    only pieces are shuffled, to drop repeats.
    """
    _check(limit, overlap)
    src = need(blocks, "id", "content", "start_line").where(F.char_length("content") > limit)

    def cut(batches):
        for pdf in batches:
            rows = []
            for i, text, line in zip(pdf["id"], pdf["content"], pdf["line"]):
                raw = text.encode("utf-8", "surrogatepass")
                hash_, known = hashlib.sha256(raw).hexdigest()[:16], i is not None and i == i and i is not pd.NA
                r = Ranges(lambda at, n, raw=raw: raw[at : at + n], len(raw), limit, overlap, range_bytes)
                index = chars = lines = 0
                for k in range(r.count):
                    n, m, pieces = r.pieces(k)
                    for lo, hi, above, body in pieces:
                        rows.append((known, int(i) if known else 0, index, _plain(body), int(line) + lines + above, chars + lo, chars + hi, hash_, int(line)))
                        index += 1
                    chars, lines = chars + n, lines + m
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    columns = ["known", "id", "block_index", "content", "start_line", "start_char", "end_char", "source_hash", "line"]
    got = src.select(F.col("id").cast("bigint").alias("id"), "content", F.coalesce("start_line", F.lit(1)).alias("line")).mapInPandas(cut, "known boolean, id bigint, block_index int, content string, start_line int, start_char bigint, end_char bigint, source_hash string, line int")
    got = got.dropDuplicates(["known", "id", "source_hash", "line", "block_index"])
    return got.select(F.when(F.col("known"), F.col("id")).alias("id"), *[c.split()[0] for c in PIECES.split(", ")][1:])


def _open(path: str):
    """A file of any storage that Arrow knows, to be read at any offset."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def split_files(files: DataFrame, limit: int = 2000, overlap: int = 200, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`path, block_index, content, start_line, start_char, end_char`: the pieces of files(path, size), as `split_oversized` cuts their text.

    A task reads one range with its halo at a time. The files' ranges are stitched by
    prefix sums over a small table of one row per range. Defined results: rows with a
    null path or size, and repeated paths, count once or not at all; a file of at most
    `limit` characters gives no pieces; a missing file is an error.
    """
    _check(limit, overlap)
    step = max(range_bytes, 16 * limit)
    files = files.select("path", F.col("size").cast("bigint").alias("size")).where("path is not null and size > 0").dropDuplicates(["path"])
    ranges = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / step))).alias("part"))

    def cut(batches):
        for pdf in batches:
            for path, g in pdf.groupby("path"):
                with _open(path) as f:
                    size = int(g["size"].iloc[0])
                    r = Ranges(lambda at, n, f=f: f.read_at(n, at), size, limit, overlap, range_bytes)
                    for k in g["part"]:
                        n, m, pieces = r.pieces(int(k))
                        yield pd.DataFrame([(path, int(k), j, n, m, lo, hi, above, _plain(body)) for j, (lo, hi, above, body) in enumerate(pieces)], columns=columns)

    columns = ["path", "part", "j", "chars", "lines", "lo", "hi", "above", "content"]
    # a fixed number: rows of ranges are small, and would be put together into few tasks
    spread = ranges.repartition(max(1, min(100_000, ranges.count())), "path", "part")
    got = materialise(spread.mapInPandas(cut, "path string, part bigint, j int, chars bigint, lines bigint, lo bigint, hi bigint, above bigint, content string"), "pieces")
    sums = got.groupBy("path", "part").agg(F.count("*").alias("pieces"), F.first("chars").alias("chars"), F.first("lines").alias("lines"))
    front = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(front), F.lit(0)).alias(f"{c}_before") for c in ("pieces", "chars", "lines")]
    whole = F.sum("chars").over(Window.partitionBy("path")).alias("total")
    out = got.join(sums.select("path", "part", *before, whole).where(F.col("total") > limit), ["path", "part"])
    return out.select("path", (F.col("pieces_before") + F.col("j")).cast("int").alias("block_index"), "content", (F.col("lines_before") + F.col("above") + 1).cast("int").alias("start_line"), (F.col("chars_before") + F.col("lo")).alias("start_char"), (F.col("chars_before") + F.col("hi")).alias("end_char"))


def violations(blocks: DataFrame, pieces: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """One row: the number of texts that must be cut, and of pieces that break a rule.

    `too_long`, `overlap_too_long`, `gaps` (a piece doesn't reach the next, or the text's
    ends), `wrong_text` and `wrong_line`; `not_whole_lines`: an overlap that doesn't begin
    at the first line that fits, though there is one. For tests: holds one text at a time.
    """
    src = need(blocks, "id", "content", "start_line").where(F.char_length("content") > limit)
    hash_ = F.substring(F.sha2("content", 256), 1, 16)
    src = src.select("id", hash_.alias("source_hash"), "content", F.coalesce("start_line", F.lit(1)).alias("line")).dropDuplicates(["id", "source_hash"])
    columns = ["texts", "too_long", "overlap_too_long", "gaps", "wrong_text", "wrong_line", "not_whole_lines"]

    def look(texts: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        n = dict.fromkeys(columns, 0)
        n["texts"] = len(texts)
        for text, line in zip(texts["content"], texts["line"]):
            p = parts.sort_values("block_index")
            p = p[p["block_index"].diff().fillna(1) > 0]
            end = prev = 0
            for body, at, lo, hi in zip(p["content"], p["start_line"], p["start_char"], p["end_char"]):
                n["too_long"] += hi - lo > limit or len(body) > limit
                n["overlap_too_long"] += end - lo > overlap
                n["gaps"] += lo > end or hi <= end
                n["wrong_text"] += body != text[lo:hi]
                n["wrong_line"] += at != line + text.count("\n", 0, lo)
                if lo or end:
                    fits = text.find("\n", max(end - overlap, prev + 1) - 1, end - 1) + 1
                    n["not_whole_lines"] += bool(fits) and lo != fits
                prev, end = lo, hi
            n["gaps"] += end != len(text)
        return pd.DataFrame([n])

    both = src.groupBy("id", "source_hash").cogroup(pieces.groupBy("id", "source_hash")).applyInPandas(look, ", ".join(f"{c} bigint" for c in columns))
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
