"""Problem 8: held-out passages inside the training text, by suffix arrays.

The corpus is cut into shards of whole documents. Each shard gets the array of
its word suffixes, sorted by their first words; every suffix of every held-out
item is looked up in it by binary search, all at once. What comes out is, for
each document and item, the longest verbatim passage and its two places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lithoscope.session import need

#: Matches of a window that are looked at together.
MOST_HITS = 1 << 21
WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits, lower-cased."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter that grows in lower case must not cut its word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(low)


class HeldOut:
    """The items of one block: vocabulary, word ids, and the suffixes to look for."""

    def __init__(self, items: list[tuple[int, str | None]], span: int):
        self.vocab: dict[str, int] = {}
        ids, starts, item, at, length = [], [], [], [], []
        pos = 0
        for key, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)]
            if w:
                n = min(span, len(w))
                for i in range(len(w) - n + 1):
                    starts.append(pos + i), item.append(key), at.append(i), length.append(n)
                ids += [*w, 0]
                pos += len(w) + 1
        self.ids = np.array([*ids, *[0] * span], np.int32)
        self.start, self.item, self.at, self.need = (np.array(x, np.int64) for x in (starts, item, at, length))
        self.shortest = int(self.need.min()) if len(self.need) else 0
        # equal suffixes are looked up once: the first of each run of equal n-word windows stands for all
        self.order = np.lexsort([self.ids[self.start + j] * (j < self.need) for j in reversed(range(span))] + [self.need]) if len(self.need) else self.need
        windows = np.stack([self.ids[self.start + j] * (j < self.need) for j in range(span)], 1)[self.order] if len(self.need) else np.zeros((0, span), np.int32)
        need = self.need[self.order]
        fresh = np.ones(len(need), bool)
        fresh[1:] = (windows[1:] != windows[:-1]).any(1) | (need[1:] != need[:-1])
        self.first = np.flatnonzero(fresh)  # in `order`
        self.count = np.diff(np.append(self.first, len(need)))


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Places of `s` sorted by their next `depth` numbers, by doubling ranks."""
    n = len(s)
    rank, k = s.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        if k < n:
            after[: n - k] = rank[k:]
        if k >= depth:
            return np.argsort(rank, kind="stable")
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[order] = np.concatenate([[1], 1 + np.cumsum(key[order][1:] != key[order][:-1])]) if n else []
        rank, k = step, 2 * k


def _bound(s, sa, ids, start, n, right):
    """For each suffix, the first place in `sa` whose `n` words are not less (right: greater)."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(sa), np.int64)
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        sign, undecided = np.zeros(len(live), np.int8), np.arange(len(live))
        for j in range(n):
            a = s[sa[mid[undecided]] + j]
            b = ids[start[live[undecided]] + j]
            sign[undecided] = np.sign(a - b)
            undecided = undecided[a == b]
            if not len(undecided):
                break
        less = sign <= 0 if right else sign < 0
        lo[live[less]], hi[live[~less]] = mid[less] + 1, mid[~less]


def search_shard(texts: list[str | None], held: HeldOut, span: int):
    """Arrays doc, item, doc_word, item_word, n_words: the longest match of each document and item."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(held.need):
        return none
    ids, sizes = [], []
    get = held.vocab.get
    for t in texts:
        w = words(t)
        sizes.append(len(w) + 1)
        ids += [get(x, 0) for x in w]
        ids.append(0)
    raw = np.array(ids, np.int32)
    first = np.cumsum([0, *sizes[:-1]])
    # a word that no item has ends every match: only runs of known words are indexed
    known = raw != 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    keep = end - begin >= held.shortest
    begin, end = begin[keep], end[keep]
    if not len(begin):
        return none
    length = end - begin + 1  # with the 0 behind the run
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    s = np.concatenate([raw[where], np.zeros(span + 1, np.int32)])
    sa = suffix_array(s, span)
    q = held.order[held.first]
    lo, hi = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for n in np.unique(held.need[q]):
        same = np.flatnonzero(held.need[q] == n)
        lo[same] = _bound(s, sa, held.ids, held.start[q[same]], int(n), False)
        hi[same] = _bound(s, sa, held.ids, held.start[q[same]], int(n), True)
    hit = np.flatnonzero(hi > lo)
    # every (suffix, place) of a window, a bounded number of them at a time
    pairs, best = (hi - lo)[hit] * held.count[hit], none
    lots = np.searchsorted(np.cumsum(pairs), np.arange(0, int(pairs.sum()), MOST_HITS), "right") if len(hit) else []
    for a, b in zip(lots, [*lots[1:], len(hit)]):
        for h in _slices(hit[a:b], (hi - lo)[hit[a:b]], held.count[hit[a:b]]):
            best = _longest(best, _extend(s, sa, held, where, first, lo, *h))
    return best


def _slices(hit, places, suffixes):
    """(window, from place, to place) of windows with their places; one with very many is cut."""
    whole = places * suffixes <= MOST_HITS
    if whole.any():
        yield hit[whole], np.zeros(int(whole.sum()), np.int64), places[whole]
    for w, n, m in zip(hit[~whole], places[~whole], suffixes[~whole]):
        step = max(1, MOST_HITS // int(m))
        for a in range(0, int(n), step):
            yield np.array([w]), np.array([a]), np.array([min(step, int(n) - a)])


def _extend(s, sa, held, where, first, lo, windows, skip, n):
    """doc, item, doc_word, item_word, n_words of all matches of some windows, each extended to its full length."""
    p = sa[np.repeat(lo[windows] + skip, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    w = np.repeat(windows, n)
    m = held.count[w]
    q = held.order[np.repeat(held.first[w], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
    p = np.repeat(p, m)
    # a match that begins a word earlier in both texts is a part of that one
    before = (held.at[q] > 0) & (p > 0)
    inner = before & (s[np.maximum(p - 1, 0)] == held.ids[held.start[q] - before]) & (s[np.maximum(p - 1, 0)] != 0)
    q, p = q[~inner], p[~inner]
    size, live = held.need[q].copy(), np.arange(len(q))
    while len(live):
        i, j = np.minimum(p[live] + size[live], len(s) - 1), np.minimum(held.start[q[live]] + size[live], len(held.ids) - 1)
        live = live[(s[i] == held.ids[j]) & (s[i] != 0)]
        size[live] += 1
    place = where[p]
    doc = np.searchsorted(first, place, "right") - 1
    return doc, held.item[q], place - first[doc], held.at[q], size


def _longest(*found):
    """One match per document and item: the longest, then the earliest in the document, then in the item."""
    doc, item, a, b, size = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a, -size, item, doc))
    d, it = doc[order], item[order]
    top = order[np.concatenate([[True], (d[1:] != d[:-1]) | (it[1:] != it[:-1])])] if len(order) else order
    return doc[top], item[top], a[top], b[top], size[top]


def leaked_passages(documents: DataFrame, items: DataFrame, span: int = 13, block_chars: int = 8_000_000, shard_chars: int = 12_000_000) -> DataFrame:
    """`doc_id, item_id, doc_word, item_word, n_words`, one row per document and leaked item.

    A document holds a case of an item if `span` consecutive words of the item
    stand consecutively in it, or all words of a shorter item. The row gives the
    longest such passage: its place in words in either text and its length; ties
    go to the earliest place in the document, then in the item.

    Items are looked up in blocks of about `block_chars` characters, or of one longer
    item (a bound on what each task and the driver hold); with more there are more passes
    over the corpus, which is unavoidable while each task holds one block. A shard holds
    whole documents up to `shard_chars` characters, or one longer document. No
    shuffle. Defined results: null and empty texts, and items without a word, are
    never cases; repeated rows give repeated rows; other columns are ignored.
    """
    items = need(items, "item_id", "text")
    docs = need(documents, "doc_id", "text")
    items = items.where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_chars))
    out = None
    for k in range(blocks):
        # by a hash of id and text: blocks of about one size, and no list of all items anywhere
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        held = docs.sparkSession.sparkContext.broadcast(HeldOut([tuple(r) for r in part.toLocalIterator()], span))

        def run(batches, held=held):
            keys, texts, chars = [], [], 0

            def flush():
                doc, item, a, b, n = search_shard(texts, held.value, span)
                return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in doc], pa.int64()), *(pa.array(x, pa.int64()) for x in (item, a, b, n))], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    keys.append(key), texts.append(text)
                    chars += len(text or "")
                    if chars >= shard_chars:
                        yield flush()
                        keys, texts, chars = [], [], 0
            if keys:
                yield flush()

        got = docs.mapInArrow(run, "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint")
        out = got if out is None else out.unionByName(got)
    return out


def without_leaks(documents: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents in which no passage was found; rows without an id are kept."""
    return documents.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
