"""Column functions on vectors and fingerprints."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str) -> Column:
    return F.sqrt(F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: str, b: str) -> Column:
    """Cosine similarity; 0 where a vector is all zero, null where the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None)).when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def unpack_float32(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())


def pack_float32(vector: pd.Series) -> pd.Series:
    return vector.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def simhash64(text: str | None, gram: int = 4) -> int | None:
    """64-bit similarity hash of a text's character runs, as a signed number.

    Each run of `gram` characters votes by the last eight bytes of its MD5; shorter
    texts give 0 and null gives null.
    """
    if text is None:
        return None
    n = len(text) - gram + 1
    if n < 1:
        return 0
    md5 = hashlib.md5
    tails = b"".join([md5(text[i : i + gram].encode("utf-8", "replace")).digest()[8:] for i in range(n)])
    bits = np.unpackbits(np.frombuffer(tails, np.uint8).reshape(n, 8), axis=1)
    up = 2 * bits.sum(0, dtype=np.int64) > n
    return int(np.packbits(up).view(">i8")[0])


def _simhash(text: pd.Series) -> pd.Series:
    """`simhash64` of many texts at once: each distinct run of the batch is hashed once."""
    gram = 4
    known = [t if isinstance(t, str) else None for t in text]
    runs = [t[i : i + gram] for t in known if t for i in range(len(t) - gram + 1)]
    codes, first = pd.factorize(np.array(runs, dtype=object)) if runs else (np.zeros(0, np.int64), [])
    md5 = hashlib.md5
    tails = b"".join([md5(r.encode("utf-8", "replace")).digest()[8:] for r in first])
    bits = np.unpackbits(np.frombuffer(tails, np.uint8).reshape(-1, 8), axis=1)
    out, at = [], 0
    for t in known:
        n = 0 if t is None else max(len(t) - gram + 1, 0)
        if n:
            up = 2 * bits[codes[at : at + n]].sum(0, dtype=np.int64) > n
            out.append(int(np.packbits(up).view(">i8")[0]))
        else:
            out.append(None if t is None else 0)
        at += n
    return pd.Series(out, dtype="Int64")


def simhash(text: str | Column) -> Column:
    return F.pandas_udf(_simhash, "bigint")(text)


def hamming(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def cut(h: str, b: int, width: int, bits: int) -> Column:
    """`bits` bits of a number from bit `b * width` on."""
    piece = F.shiftrightunsigned(h, b * width)
    return piece.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else piece


def bands(h: str, distance: int, bits: int = 64) -> Column:
    """`distance` + 1 slices of a hash of `bits` bits: hashes within the distance share at least one.

    Each comes with the other bits, closed up, as `rest`.
    """
    n = distance + 1
    width = bits // n
    parts = []
    for b in range(n):
        own = width if b < n - 1 else bits - b * width
        low = F.col(h).bitwiseAND(F.lit((1 << (b * width)) - 1))
        high = F.shiftleft(F.shiftrightunsigned(h, b * width + own), b * width) if b * width + own < 64 else F.lit(0).cast("bigint")
        parts.append(F.struct(F.lit(b).alias("band"), cut(h, b, width, own).cast("bigint").alias("slice"), low.bitwiseOR(high).cast("bigint").alias("rest")))
    return F.array(*parts)
