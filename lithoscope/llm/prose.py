"""Problem 9: text statistics, and natural prose told from lists, tables and junk.

Each text is cut into segments of a few lines. A segment's distributions of word
kinds and of character classes are compared with structural profiles (prose,
list, table, code, ...) by Jensen-Shannon divergence, and the nearest profile
names it. A text's common words are compared in the same way with the profiles of the
languages, which are counted over the corpus. Words strung together at random have the unigram profile of prose, so
prose must also join its common words as the corpus does: the mean association
of neighbouring common words, counted over the whole corpus, decides.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lithoscope.session import need

TOKEN = re.compile(r"\w+|\n")
KINDS = ("function", "plain", "number", "identifier")
CHARS = ("letter", "digit", "space", "stop", "symbol")

#: Shares of word kinds (KINDS) and of character classes (CHARS).
PROFILES = {
    "prose": ((0.42, 0.55, 0.02, 0.01), (0.80, 0.01, 0.165, 0.02, 0.005)),
    "terse_prose": ((0.16, 0.78, 0.05, 0.01), (0.815, 0.015, 0.145, 0.02, 0.005)),
    "list": ((0.01, 0.60, 0.09, 0.30), (0.74, 0.04, 0.12, 0.04, 0.06)),
    "table": ((0.10, 0.45, 0.35, 0.10), (0.50, 0.20, 0.15, 0.06, 0.09)),
    "code": ((0.08, 0.40, 0.07, 0.45), (0.60, 0.04, 0.22, 0.05, 0.09)),
    "log": ((0.04, 0.46, 0.40, 0.10), (0.50, 0.22, 0.13, 0.10, 0.05)),
    "hex_dump": ((0.00, 0.10, 0.70, 0.20), (0.25, 0.50, 0.23, 0.01, 0.01)),
    "encoded": ((0.00, 0.30, 0.10, 0.60), (0.80, 0.15, 0.00, 0.00, 0.05)),
    "noise": ((0.00, 0.50, 0.30, 0.20), (0.20, 0.15, 0.05, 0.15, 0.45)),
    "enumeration": ((0.00, 0.98, 0.01, 0.01), (0.78, 0.01, 0.14, 0.03, 0.04)),
}
NAMES = tuple(PROFILES)
PROSE = ("prose", "terse_prose")
#: Characters with which a line of sentences ends.
ENDS = frozenset(".!?:;…。！？\"”'")
#: Texts that are worked out together: at most so many, and about so many characters.
BATCH_TEXTS, BATCH_CHARS = 256, 500_000
#: Least words of a segment, and of the window over which association is averaged.
SEGMENT_WORDS, WINDOW_WORDS = 12, 40
#: Largest shares of symbols among the characters, and of numbers among the words, of a prose segment.
MOST_SYMBOLS, MOST_NUMBERS = 0.10, 0.2


def _char_classes() -> np.ndarray:
    out = np.zeros(0x3100, np.int8)  # letters, unless said otherwise
    for c in range(0x3100):
        s = chr(c)
        if s.isspace():
            out[c] = 2
        elif s.isdigit():
            out[c] = 1
        elif s in ".,;:?!'\"()¿¡«»’“”…-–":
            out[c] = 3
        elif not s.isalpha():
            out[c] = 4
    return out


_CLASSES = _char_classes()


class Lexicon:
    """Codes of words: 1.. the common words, 0 plain, -1 number, -2 identifier, -9 line end."""

    def __init__(self, common: list[tuple[str, str]]):
        self.words = sorted({w.lower() for _, w in common if w})
        self.code = {w: i + 1 for i, w in enumerate(self.words)}
        langs = sorted({lang for lang, w in common if lang and w})
        self.langs = langs
        self.member = np.zeros((len(langs), len(self.words) + 1), bool)
        for lang, w in common:
            if lang and w:
                self.member[langs.index(lang), self.code[w.lower()]] = True
        self._memo: dict[str, int] = {"\n": -9}

    def lookup(self, token: str) -> int:
        got = self.code.get(token.lower())
        if got is None:
            if token.isdigit():
                got = -1
            elif token.isalpha() and (token[1:].islower() or token.islower() or token.isupper() or not token[1:]):
                got = 0
            elif any(c.isdigit() for c in token) and not any(c == "_" for c in token) and sum(c.isdigit() for c in token) * 2 >= len(token):
                got = -1
            else:
                got = -2
        if len(self._memo) > 300_000:
            self._memo = {"\n": -9}
        self._memo[token] = got
        return got

    def codes(self, text: str) -> np.ndarray:
        """Codes of the words and line ends of a text."""
        known, new = self._memo.get, self.lookup
        tokens = TOKEN.findall(text)
        out = list(map(known, tokens))
        if None in out:
            out = [new(t) if c is None else c for t, c in zip(tokens, out)]
        return np.array(out, np.int16)


def clean(text: str | None) -> str:
    return (text or "").replace("\r\n", "\n").replace("\r", "\n")


#: Least common words of a text that tells of its language's profile.
LANGUAGE_WORDS = 20


def pair_counts(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (first * size + second) of neighbouring common or plain words, and how often each occurs."""
    c = codes[codes != -9].astype(np.int64)
    a, b = c[:-1], c[1:]
    ok = (a >= 0) & (b >= 0)
    return np.unique(a[ok] * size + b[ok], return_counts=True)


class Counts:
    """What the whole corpus says: pairs of neighbouring words, and each language's distribution of common words.

    Only pairs that occur are kept, at most (common words + 1) squared of them.
    """

    def __init__(self, cell: np.ndarray, n: np.ndarray, size: int, languages: np.ndarray):
        order = np.argsort(cell)
        self.cell, self.n, self.size = cell[order], n[order].astype(float), size
        self.row = np.bincount(self.cell // size, self.n, size)
        self.col = np.bincount(self.cell % size, self.n, size)
        self.total = max(self.n.sum(), 1)
        self.languages = languages / np.maximum(languages.sum(1, keepdims=True), 1)

    def of(self, cell: np.ndarray) -> np.ndarray:
        if not len(self.cell):
            return np.zeros(len(cell))
        at = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
        return np.where(self.cell[at] == cell, self.n[at], 0.0)

    def by_chance(self, cell: np.ndarray) -> np.ndarray:
        return self.row[cell // self.size] * self.col[cell % self.size] / self.total


def corpus_counts(documents: DataFrame, lexicon: Lexicon) -> Counts:
    """Counts of neighbouring words over all different texts, and the languages' profiles.

    A text counts once however many rows repeat it, so that copies don't speak for each
    other; copies collapse before the texts are shuffled. Each task sends the pairs
    that it has met, and Spark adds them up. A text adds to the profile of the language
    most of whose common words it holds, if it holds LANGUAGE_WORDS of them.
    """
    size, langs = len(lexicon.words) + 1, max(1, len(lexicon.langs))
    end = np.array([-8], np.int16)

    def run(batches):
        profile = np.zeros((langs, size), np.int64)
        for pdf in batches:
            parts = []
            for t in pdf["text"]:
                if t:
                    c = lexicon.codes(t)
                    parts += [c, end]
                    c = c[c > 0]
                    if len(c) >= LANGUAGE_WORDS and len(lexicon.langs):
                        profile[lexicon.member[:, c].sum(1).argmax()] += np.bincount(c, minlength=size)
            if parts:
                cell, n = pair_counts(np.concatenate(parts), size)
                yield pd.DataFrame({"cell": cell, "n": n})
        flat = profile.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"cell": -1 - at, "n": flat[at]})

    got = need(documents, "text").where("text is not null").distinct().mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cell, n = got["cell"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    profile = np.zeros(langs * size)
    profile[-1 - cell[cell < 0]] = n[cell < 0]
    return Counts(cell[cell >= 0], n[cell >= 0], size, profile.reshape(langs, size))


def language_divergence(doc: np.ndarray, word: np.ndarray, docs: int, counts: Counts) -> np.ndarray:
    """(languages, docs): Jensen-Shannon divergence in bits of the documents' common words and each language's profile."""
    key, n = np.unique(doc[word > 0] * counts.size + word[word > 0], return_counts=True)
    d, w = key // counts.size, key % counts.size
    p = n / np.maximum(np.bincount(d, n, docs), 1)[d]
    out = []
    for profile in counts.languages:
        q = profile[w]
        with np.errstate(divide="ignore", invalid="ignore"):
            both = p * np.log2(2 * p / (p + q)) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)
        # a word that only the profile has adds all of its share
        out.append((np.bincount(d, both, docs) + (profile.sum() - np.bincount(d, q, docs))) / 2)
    return np.array(out)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of p and each row of q."""
    p, q = p[:, None, :], q[None, :, :]
    m = (p + q) / 2

    def kl(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(2)

    return (kl(p) + kl(q)) / 2


_WORD_PROFILES = np.array([v[0] for v in PROFILES.values()])
_CHAR_PROFILES = np.array([v[1] for v in PROFILES.values()])
_IS_PROSE = np.array([n in PROSE for n in NAMES])


def _segments(words: np.ndarray, begins: np.ndarray, least: int) -> np.ndarray:
    """Number of each line's segment: within a text, lines are added until `least` words are there.

    `begins` marks the first line of each text; too short a rest joins the segment
    in front.
    """
    out, k, have, first, start = np.zeros(len(words), np.int64), -1, 0, -1, 0
    for i, (n, new) in enumerate(zip(words.tolist(), begins.tolist())):
        if new:
            if have < least and k > first:
                out[start:i] -= 1
                k -= 1
            k, have, start = k + 1, 0, i
            first = k
        elif have >= least:
            k, have, start = k + 1, 0, i
        out[i] = k
        have += n
    if have < least and k > first:
        out[start:] -= 1
    return out


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, j], n) for j in range(values.shape[1])], 1)


def describe(texts: list[str | None], lexicon: Lexicon, counts: Counts, least_association: float) -> list[tuple]:
    """The figures of some texts, worked out together; see `quality`.

    The association of two words is the logarithm of their count over that by chance;
    a text's own pairs don't count, so that it can't speak for itself.
    """
    cleaned = [clean(t) for t in texts]
    used = [i for i, t in enumerate(cleaned) if t.strip()]
    out: list[tuple] = [(0, 0.0, 0.0, 0.0, 0.0, None, None, 0.0, None, 0.0)] * len(texts)
    if not used:
        return out
    body = [cleaned[i] for i in used]
    docs = len(body)
    whole = "\n".join(body)
    lines = whole.split("\n")
    doc_of_line = np.repeat(np.arange(docs), [t.count("\n") + 1 for t in body])
    n_lines = len(lines)
    begins = np.concatenate([[True], doc_of_line[1:] != doc_of_line[:-1]])
    length = np.array([len(x) for x in lines])

    codes = lexicon.codes(whole)
    breaks = codes == -9
    word, line = codes[~breaks].astype(np.int64), np.cumsum(breaks)[~breaks]
    doc = doc_of_line[line]
    kind = np.where(word > 0, 0, np.where(word == 0, 1, np.where(word == -1, 2, 3)))
    kinds = np.bincount(line * 4 + kind, minlength=n_lines * 4).reshape(n_lines, 4)
    cp = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    cls = _CLASSES[np.where(cp < 0x3100, cp, 0x61)]
    tight = ((cp[:-1] == 0x3B) | (cp[:-1] == 0x2C)) & (cls[1:] != 2)  # a separator, not a stop
    cls[:-1][tight] = 4
    cls[np.cumsum([len(t) + 1 for t in body])[:-1] - 1] = 5  # the line ends between texts
    chars = np.bincount(np.repeat(np.arange(n_lines), length + (np.arange(n_lines) < n_lines - 1)) * 6 + cls, minlength=n_lines * 6).reshape(n_lines, 6)[:, :5]

    seg = _segments(kinds.sum(1), begins, SEGMENT_WORDS)
    k = int(seg[-1]) + 1
    seg_kinds, seg_chars, seg_len = _sums(seg, kinds, k), _sums(seg, chars, k), np.bincount(seg, length, k)
    seg_doc = np.zeros(k, np.int64)
    seg_doc[seg] = doc_of_line
    p = seg_kinds / np.maximum(seg_kinds.sum(1, keepdims=True), 1)
    q = seg_chars / np.maximum(seg_chars.sum(1, keepdims=True), 1)
    nearest = (divergence(p, _WORD_PROFILES) + divergence(q, _CHAR_PROFILES)).argmin(1)
    prose = _IS_PROSE[nearest] & (seg_kinds.sum(1) > 0) & (q[:, 4] <= MOST_SYMBOLS) & (p[:, 2] <= MOST_NUMBERS)

    # association of neighbours, over windows of whole segments
    window = _segments(seg_kinds.sum(1).astype(np.int64), np.concatenate([[True], seg_doc[1:] != seg_doc[:-1]]), WINDOW_WORDS)
    a, b = word[:-1], word[1:]
    ok = (a >= 0) & (b >= 0) & ((a > 0) | (b > 0)) & (doc[1:] == doc[:-1])
    at = window[seg[line[:-1]]][ok]
    w = int(window[-1]) + 1
    size = len(lexicon.words) + 1
    cell = a[ok] * size + b[ok]
    _, same, own = np.unique(doc[:-1][ok] * (size * size) + cell, return_inverse=True, return_counts=True)
    joint = np.log((np.maximum(counts.of(cell) - own[same], 0) + 0.5) / (counts.by_chance(cell) + 0.5))
    total, count = np.bincount(at, joint, w), np.bincount(at, minlength=w)
    prose &= (total / np.maximum(count, 1) >= least_association)[window]

    per = lambda index, values=None: np.bincount(index, values, docs)
    chars_of = per(seg_doc, seg_len)
    share = per(seg_doc, seg_len * prose) / np.maximum(chars_of, 1)
    shapes = np.bincount(seg_doc * len(NAMES) + nearest, seg_len, docs * len(NAMES)).reshape(docs, -1)
    good = np.bincount((seg_doc * len(NAMES) + nearest)[prose], seg_len[prose], docs * len(NAMES)).reshape(docs, -1)
    n_words = per(doc)
    common = per(doc, word > 0) / np.maximum(n_words, 1)
    letters, symbols = per(doc_of_line, chars[:, 0] + chars[:, 1]), per(doc_of_line, chars[:, 4])
    apart = language_divergence(doc, word, docs, counts)
    speaks = per(doc, word > 0) > 0
    held, ended = np.zeros(docs), np.zeros(docs)
    for d, x in zip(doc_of_line.tolist(), lines):
        x = x.rstrip()
        if x:
            held[d] += 1
            ended[d] += x[-1] in ENDS
    window_doc = np.zeros(w, np.int64)
    window_doc[window] = seg_doc
    joined = per(window_doc, total) / np.maximum(per(window_doc, count), 1)
    for d, i in enumerate(used):
        profile = NAMES[int((good if share[d] > 0.5 else shapes)[d].argmax())]
        if share[d] < 0.5 and profile in PROSE:
            profile = "word_salad"
        lang = lexicon.langs[int(apart[:, d].argmin())] if speaks[d] and len(lexicon.langs) else None
        n = int(n_words[d])
        out[i] = (n, float(letters[d] / n) if n else 0.0, float(symbols[d] / len(body[d])), float(ended[d] / max(held[d], 1)), float(common[d]), lang, float(apart[:, d].min()) if lang else None, float(share[d]), profile, float(joined[d]))
    return out


SCHEMA = "doc_id bigint, n_words int, mean_word_length double, symbol_ratio double, ended_lines double, common_share double, common_lang string, lang_divergence double, prose_share double, profile string, association double"


def quality(documents: DataFrame, common_words: DataFrame, least_association: float = -0.15, max_words: int = 2000) -> DataFrame:
    """One row of figures per document (columns: SCHEMA).

    `prose_share` is the share of characters in segments of running sentences;
    `profile` the structural profile of most characters (`word_salad`: common words
    that aren't joined as in sentences); `common_lang` the language whose distribution
    of common words is nearest, `lang_divergence` away. Two passes over the whole corpus,
    the first of which counts pairs of neighbouring words of the different texts (one
    shuffle of texts). `common_words` may have up to `max_words` rows, so that at most
    (max_words + 1) squared counts (64 MB) go to the tasks; more are an error.

    Defined results: null, empty and blank texts have 0 words, `prose_share` 0 and
    a null profile; mixed line ends count as one; texts are read whole; repeated
    rows give repeated rows; other columns are ignored.
    """
    rows = need(common_words, "lang", "word").limit(max_words + 1).collect()
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} common words")
    lexicon = Lexicon([tuple(r) for r in rows])
    docs = need(documents, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, corpus_counts(docs, lexicon)))

    def run(batches):
        lex, counts = shared.value
        for pdf in batches:
            got, part, chars = [], [], 0
            for t in [*pdf["text"], None]:
                if part and (len(part) >= BATCH_TEXTS or chars >= BATCH_CHARS):
                    got += describe(part, lex, counts, least_association)
                    part, chars = [], 0
                part.append(t)
                chars += len(t or "")
            got += describe(part[:-1], lex, counts, least_association) if len(part) > 1 else []
            out = pd.DataFrame(got, columns=[c.split()[0] for c in SCHEMA.split(", ")][1:])
            out.insert(0, "doc_id", pdf["doc_id"])
            yield out

    return docs.mapInPandas(run, SCHEMA)


def not_prose(figures: DataFrame) -> DataFrame:
    """Documents of which more than half of the characters aren't running sentences."""
    return figures.where(F.col("profile").isNotNull() & (F.col("prose_share") < 0.5)).select("doc_id")
