"""Problem 3: near-duplicate texts by a token-group matrix.

Texts become sets of word shingles. Similar texts are put into one group (by the
smallest hash of their shingles), and the matrix holds, for each group, the union
of its members' tokens. A text opens only groups whose union overlaps it enough:

* Prefix rows. Under one global order of the tokens (rare ones first), two sets of
  similarity t share their first k common tokens within the first
  |x| - ceil(t |x|) + k of each. The matrix therefore holds the unions of these
  prefixes, and a text looks up only its own prefix: one shuffle, by token.
* Bound. Fewer than k shared tokens with a group's row rule out all its members.
* Opening. The members of a qualifying group come out with their full sets, and an
  exact check compares those whose sizes leave room for the similarity.

The order of tokens comes from a count sketch over all texts. It grows with the
corpus up to a bound (8 MB of cells); what the cells hold by mere chance, their median,
is taken off, so that frequent tokens stand out however full it is. Tokens that are
frequent by the sketch go through a join that is salted by their frequency, the others
through a plain one; the exact check splits large groups. No candidates are dropped or
capped.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lithoscope.session import materialise

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Least and most bits of a sketch's cells; characters of text for each cell, as far as the bound allows.
SKETCH_BITS, CHARS_PER_CELL = (16, 22), 48
#: Members of a group that one key of the exact check holds.
GROUP_ROWS = 512
#: Most ids that a bitmap stands for; more go through a join.
BITMAP_IDS = 1 << 24


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, keep: int = 200_000):
        self.keep, self.memo = keep, {}

    def __call__(self, words: list[str]) -> list[int]:
        import xxhash

        memo, out = self.memo, []
        for w in words:
            h = memo.get(w)
            if h is None:
                if len(memo) >= self.keep:
                    memo.clear()
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str | None], size: int, least_words: int, hashes: WordHashes):
    """For the texts that take part: their places, and flat arrays doc, token without repeats within a text."""
    words, docs, n = [], [], []
    for i, t in enumerate(texts):
        if t is None:
            continue
        w = WORD.findall(t.lower())
        if len(w) >= max(least_words, size):
            words += hashes(w)
            docs.append(i), n.append(len(w))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, n = np.array(words, np.uint64), np.array(n)
    ends = np.cumsum(n)
    token = np.zeros(len(h), np.uint64)
    for j in range(size):
        token = mix(np.roll(h, -j) + np.uint64(j + 1) * token)
    owner = np.repeat(np.arange(len(docs)), n)
    inside = np.arange(len(h)) <= np.repeat(ends, n) - size
    owner, token = owner[inside], token[inside]
    order = np.lexsort((token, owner))
    owner, token = owner[order], token[order]
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])])
    return np.array(docs), owner[fresh], token[fresh]


def slots(token: np.ndarray, bits: int) -> np.ndarray:
    """The two sketch cells of each token."""
    cells = np.uint64((1 << bits) - 1)
    return np.stack([token & cells, (token >> np.uint64(bits)) & cells]).astype(np.int64)


def sketch_bits(texts: DataFrame) -> int:
    chars = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return int(np.clip(math.ceil(math.log2(max(chars / CHARS_PER_CELL, 1))), *SKETCH_BITS))


def token_sketch(texts: DataFrame, size: int, least_words: int, bits: int) -> np.ndarray:
    """Two rows of 2^bits levels, one byte each: eight steps for each doubling of a token's count over all texts.

    A count is that of its cell less the median of the row's cells, which is what other
    tokens put there. Tasks send their counts in packed blocks; these are added up block
    by block as they come, so that no task holds more than the sums.
    """
    cells = 1 << bits
    block = min(cells, 1 << 16)

    def run(batches):
        hashes, n = WordHashes(), np.zeros((2, cells), np.int64)
        for pdf in batches:
            _, _, token = shingles(pdf["text"].tolist(), size, least_words, hashes)
            for row, at in zip(n, slots(token, bits)):
                row += np.bincount(at, minlength=cells)
        flat = np.minimum(n.ravel(), 2**32 - 1).astype(np.uint32)
        for k in range(0, len(flat), block):
            if flat[k : k + block].any():
                yield pd.DataFrame({"block": [k // block], "n": [zlib.compress(flat[k : k + block].tobytes(), 1)]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, x in zip(pdf["block"], pdf["n"]):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.float64)
        for k, x in total.items():
            yield pd.DataFrame({"block": [k], "n": [zlib.compress(x.astype(np.float32).tobytes(), 1)]})

    out = np.zeros(2 * cells, np.float32)
    for r in texts.mapInPandas(run, "block int, n binary").repartition("block").mapInPandas(add, "block int, n binary").toLocalIterator():
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(zlib.decompress(bytes(r["n"])), np.float32)
    out = out.reshape(2, cells)
    out = np.maximum(out - np.median(out, axis=1, keepdims=True), 0)
    return np.minimum(255, np.round(8 * np.log2(1 + out))).astype(np.uint8)


def groups_of(owner: np.ndarray, token: np.ndarray, t: float):
    """Of flat sets: where each begins, its size, and its group.

    The group is the smallest hash of the set together with its size class, so that
    all members of a group have sizes within a factor t.
    """
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    n = np.diff(np.append(first, len(owner)))
    band = np.floor(np.log(n) / -math.log(t)).astype(np.uint64)
    return first, n, mix(np.minimum.reduceat(mix(token), first) + band).view(np.int64).astype(np.int32)


def prefixes(texts: DataFrame, sketch, size: int, least_words: int, t: float, hot: int, shared: int) -> DataFrame:
    """`id, n, grp, tokens, salts` of each text that takes part: its size, group and prefix, and how far to spread each token.

    Tokens and groups are cut to 32 bits here: a clash only adds candidates.
    """

    def run(batches):
        hashes, levels, seen = WordHashes(), sketch.value, set()
        bits = levels.shape[1].bit_length() - 1
        spread = np.clip(np.ceil(2 ** (np.arange(256) / 8) / hot), 1, 1 << 14).astype(np.int16)
        for pdf in batches:
            ids, body = pdf["id"].tolist(), pdf["text"].tolist()
            for i, k in enumerate(ids):  # map-side combine of exact copies
                if k in seen:
                    body[i] = None
                elif len(seen) < 500_000:
                    seen.add(k)
            docs, owner, token = shingles(body, size, least_words, hashes)
            if not len(docs):
                continue
            cells = slots(token, bits)
            level = np.minimum(levels[0][cells[0]], levels[1][cells[1]]).astype(np.int64)
            first, n, group = groups_of(owner, token, t)
            order = np.lexsort((token, level, owner))
            short, level = token[order].astype(np.uint32).view(np.int32), level[order]
            rows = []
            for d, g, lo, k in zip(docs.tolist(), group.tolist(), first.tolist(), n.tolist()):
                cut = min(lo + k, lo + k - math.ceil(t * k - 1e-9) + shared)
                rows.append((ids[d], k, g, short[lo:cut], spread[level[lo:cut]]))
            yield pd.DataFrame(rows, columns=["id", "n", "grp", "tokens", "salts"])

    return texts.select("id", "text").mapInPandas(run, "id bigint, n int, grp int, tokens array<int>, salts array<smallint>")


def full_sets(texts: DataFrame, size: int, least_words: int, t: float) -> DataFrame:
    """`id, hash, n, grp, tokens` of texts(id, hash, text): the whole sets, for the exact check."""

    def run(batches):
        hashes = WordHashes()
        for pdf in batches:
            docs, owner, token = shingles(pdf["text"].tolist(), size, least_words, hashes)
            if not len(docs):
                continue
            first, n, group = groups_of(owner, token, t)
            parts = np.split(token.view(np.int64), first[1:])
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[docs], "hash": pdf["hash"].to_numpy()[docs], "n": n, "grp": group, "tokens": parts})

    return texts.mapInPandas(run, "id bigint, hash string, n int, grp int, tokens array<bigint>")


def _qualifying(rows: DataFrame, t: float, key: list[str], matrix: DataFrame) -> DataFrame:
    """The groups that a text opens: `id, n, own, grp`.

    Of two texts only the one of the smaller group asks; a matrix row whose only
    text is the one that asks opens nothing.
    """
    m = matrix.select(*key, F.col("grp").alias("other_grp"), "lo", "hi", "first", "last")
    return (
        rows.join(m, key)
        .where((F.col("grp") <= F.col("other_grp")) & (F.col("hi") >= F.col("n") * t) & (F.col("lo") * t <= F.col("n")))
        .where((F.col("first") != F.col("last")) | (F.col("first") != F.col("id")))
        .select("id", "n", F.col("grp").alias("own"), F.col("other_grp").alias("grp"))
    )


def similar_pairs(texts: DataFrame, key: str, text: str, t: float = 0.6, size: int = 3, least_words: int = 30, hot: int = 4096, shared: int = 6, bits: int | None = None) -> DataFrame:
    """`hash_a, hash_b, similarity` (hash_a < hash_b) of different keys whose texts are at least `t` alike.

    Alike is the Jaccard similarity of the sets of all runs of `size` consecutive
    words (longest runs of [A-Za-z0-9_], lower-cased). Equal keys are equal texts.
    A text opens a group if `shared` of its prefix tokens are in the group's row.
    A token's join is spread over one task for each `hot` of its estimated count;
    `bits` is the logarithm of the sketch's width (else by the corpus).
    Defined results: null keys, null texts and texts of fewer than `least_words`
    words take no part; repeated rows count once; texts of any length are read
    whole; an empty table gives no pairs; other columns are ignored.
    """
    spark = texts.sparkSession
    texts = texts.select(F.col(f"`{key}`").cast("string").alias("hash"), F.col(f"`{text}`").alias("text")).where("hash is not null and text is not null")
    texts = texts.select(F.xxhash64("hash").alias("id"), "hash", "text")
    body = texts.select("text")
    sketch = spark.sparkContext.broadcast(token_sketch(body, size, least_words, bits or sketch_bits(body)))
    docs = materialise(prefixes(texts, sketch, size, least_words, t, hot, shared), "prefixes")

    x = F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("salts").alias("salts")))
    rows = docs.select("id", "n", "grp", x.alias("x")).select("id", "n", "grp", F.col("x.token").alias("token"), F.col("x.salts").cast("int").alias("salts"))
    rows = rows.where("id is not null and n is not null and grp is not null and token is not null")
    sums = (F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("id").alias("first"), F.max("id").alias("last"))
    # both sides of the plain join read one shuffle of the rows by token
    plain = rows.where("salts = 1").drop("salts").repartition("token")
    opened = _qualifying(plain, t, ["token"], plain.groupBy("token", "grp").agg(*sums))
    warm = rows.where("salts > 1").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    # tokens of one 32-bit value may have several salts: each row meets all groups by its own
    wide = rows.where("salts > 1").groupBy("token", "grp").agg(*sums)
    wide = wide.join(rows.where("salts > 1").groupBy("token").agg(F.max("salts").alias("most")), "token").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("most") - 1))).drop("most")
    opened = opened.unionByName(_qualifying(warm, t, ["token", "salt"], wide))
    enough = F.least(F.lit(shared), F.greatest(F.lit(1), F.ceil(F.col("n") * (t * t))))
    opened = opened.groupBy("id", "n", "own", "grp").agg(F.count("*").alias("c")).where(F.col("c") >= enough).drop("c")
    return _verify(materialise(opened, "opened"), docs, texts, t, size, least_words)


def _marks(ids: DataFrame, bits: int) -> DataFrame:
    """A bitmap of 2^bits cells, in rows of 4 KB: which ids may be among `ids`."""
    cell = F.pmod(F.col("id"), F.lit(1 << bits))
    return ids.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("map"))


def _wanted(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts that may be among ids(id), none left out: by a bitmap of at most 16 MB, or, for more ids, by a join."""
    n = ids.count()
    if n > BITMAP_IDS:
        return texts.join(ids.distinct(), "id", "left_semi")
    bits = max(15, (8 * n).bit_length())
    cell = F.pmod(F.col("id"), F.lit(1 << bits))
    d = texts.withColumn("bucket", F.bitmap_bucket_number(cell)).withColumn("at", F.bitmap_bit_position(cell))
    byte = F.conv(F.hex(F.expr("substring(map, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return d.join(F.broadcast(_marks(ids, bits)), "bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0).select("id", "hash", "text")


def _verify(opened: DataFrame, docs: DataFrame, texts: DataFrame, t: float, size: int, least_words: int) -> DataFrame:
    """Compare each text with the members of the groups that it opens.

    Only texts that ask or are asked are read into sets again. Sets move once per
    opened group, and pairs are compared where they meet. A large group is cut into
    blocks of about GROUP_ROWS askers and members; a block is one matrix product.
    """
    members = docs.select("id", "grp").join(opened.select("grp").distinct(), "grp", "left_semi")
    parts = members.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("grp", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("parts"))
    parts = materialise(parts, "large-groups")  # few rows: groups of more than GROUP_ROWS members
    sets = materialise(full_sets(_wanted(texts, opened.select("id").unionByName(members.select("id"))), size, least_words, t), "sets")
    asker, asked = sets.select("id", F.col("hash").alias("ha"), F.col("tokens").alias("a")), sets.select("grp", F.col("id").alias("other"), F.col("n").alias("m"), F.col("hash").alias("hb"), F.col("tokens").alias("b"))
    both = opened.join(parts, "grp", "left_anti").join(asker, "id").join(asked, "grp").where(
        ((F.col("own") < F.col("grp")) | (F.col("id") < F.col("other"))) & (F.col("ha") != F.col("hb")) & (F.col("m") >= F.col("n") * t) & (F.col("n") >= F.col("m") * t)
    )
    common = F.size(F.array_intersect("a", "b"))
    found = both.select("ha", "hb", (common / (F.col("n") + F.col("m") - common)).alias("similarity"))
    if not parts.isEmpty():
        found = found.unionByName(_blocks(opened, parts, asker, asked, t))
    return (
        found.where(F.col("similarity") >= t - 1e-12)
        .select(F.least("ha", "hb").alias("hash_a"), F.greatest("ha", "hb").alias("hash_b"), "similarity")
        .distinct()
    )


def _blocks(opened: DataFrame, parts: DataFrame, asker: DataFrame, asked: DataFrame, t: float) -> DataFrame:
    """`ha, hb, similarity` of the pairs of large groups."""
    opened = opened.join(parts, "grp")
    rows = opened.groupBy("grp").agg(F.ceil(F.count("*") / GROUP_ROWS).cast("int").alias("lots"))
    split = lambda key, n: F.pmod(F.xxhash64(key, F.lit(7)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = opened.join(rows, "grp").select("id", "n", "own", "grp", split("id", F.col("lots")).alias("lot"), each("parts").alias("part")).join(asker, "id")
    right = asked.join(parts, "grp").join(rows, "grp").select("grp", "other", "m", "hb", "b", each("lots").alias("lot"), split("other", F.col("parts")).alias("part"))

    def compare(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"ha": pd.Series(dtype=str), "hb": pd.Series(dtype=str), "similarity": pd.Series(dtype=float)})
        grp, n, m = key[0], x["n"].to_numpy(np.int64)[:, None], y["m"].to_numpy(np.int64)[None, :]
        common = common_tokens(x["a"].tolist(), y["b"].tolist())
        like = common / (n + m - common)
        ok = (like >= t - 1e-12) & ((x["own"].to_numpy()[:, None] < grp) | (x["id"].to_numpy()[:, None] < y["other"].to_numpy()[None, :]))
        ok &= (m >= n * t) & (n >= m * t)
        ha, hb = x["ha"].to_numpy(), y["hb"].to_numpy()
        i, j = np.nonzero(ok)
        i, j = i[ha[i] != hb[j]], j[ha[i] != hb[j]]
        return pd.DataFrame({"ha": ha[i], "hb": hb[j], "similarity": like[i, j]})

    return left.groupBy("grp", "lot", "part").cogroup(right.groupBy("grp", "lot", "part")).applyInPandas(compare, "ha string, hb string, similarity double")


def common_tokens(a: list, b: list, width: int = 8192) -> np.ndarray:
    """How many tokens each set of a has in common with each of b; the token columns are taken `width` at a time."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in (*a, *b)])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    out = np.zeros((len(a), len(b)))
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        at = slice(*np.searchsorted(code, [lo, lo + width]))
        cells = np.zeros((len(a) + len(b), width), np.float32)
        cells[owner[at], code[at] - lo] = 1
        out += cells[: len(a)] @ cells[len(a) :].T
    return out


def groups(texts: DataFrame, id_: str, key: str, pairs: DataFrame) -> DataFrame:
    """`id, hash, class, n_links` of each row of texts, given its similar pairs (hash_a, hash_b).

    `class` is the smallest key of the texts that chain together by similar pairs, the
    own key of a text without any; `n_links` is the number of different texts that are
    similar. Copies share their key's class, so they need no pairs. Defined results:
    rows with a null key have a null class and no links; repeated rows are repeated.
    """
    from lithoscope.operators.components import components

    pairs = materialise(pairs.select("hash_a", "hash_b").distinct(), "pairs")
    both = pairs.unionByName(pairs.select(F.col("hash_b").alias("hash_a"), F.col("hash_a").alias("hash_b")))
    links = both.groupBy(F.col("hash_a").alias("hash")).agg(F.count("*").alias("n_links"))
    label = components(pairs, "hash_a", "hash_b").select(F.col("node").alias("hash"), "component").join(links, "hash")
    rows = texts.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{key}`").cast("string").alias("hash"))
    return rows.join(label, "hash", "left").select("id", "hash", F.coalesce("component", "hash").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
