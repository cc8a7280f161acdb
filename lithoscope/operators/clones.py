"""Exact clones, near clones by banded similarity hashes, and semantic clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lithoscope.functions.text import like, normhash
from lithoscope.functions.vectors import bands, hamming, simhash
from lithoscope.operators.components import components
from lithoscope.plans.index import CodeIndex
from lithoscope.session import materialise

CODE = ("function", "method")


def fingerprints(ix: CodeIndex) -> DataFrame:
    """`id, file_id, name, line, normhash, simhash` of functions and methods with a snippet."""
    s = ix.symbols.where(F.col("kind").isin(*CODE) & F.col("snippet").isNotNull())
    return s.select("id", "file_id", "name", "line", normhash("snippet").alias("normhash"), simhash("snippet").alias("simhash"))


def exact_clones(ix: CodeIndex) -> DataFrame:
    """`hash, path, line, name, n`: hashes in more than one file, with their first place and copies (one per path)."""
    s = ix.symbols.where(F.col("kind").isin(*CODE) & F.col("snippet").isNotNull()).select("file_id", "name", "line", normhash("snippet").alias("hash"))
    g = s.join(ix.scope, "file_id").groupBy("hash").agg(F.countDistinct("file_id").alias("files"), F.count("*").alias("n"), F.min(F.struct("path", "line", "name")).alias("at"))
    return g.where("files > 1").select("hash", "at.path", "at.line", "at.name", "n")


def near_pairs(hashes: DataFrame, distance: int, hot: int = 2000) -> DataFrame:
    """`a, b, distance` (a < b) of hashes(h) within a Hamming distance: pairs of distinct hash values.

    Values within the distance share one of `distance` + 1 slices (the pigeonhole
    principle), so the join on slices is complete. Equal values were collapsed
    before, so copies cost nothing. A slice value with more than `hot` members is cut
    once more, by the bands of the other bits, which are near too.
    """
    h = hashes.select("h").distinct()
    keys = h.select("h", F.explode(bands("h", distance)).alias("k")).select("h", "k.*")
    size = keys.groupBy("band", "slice").agg(F.count("*").alias("n"))
    keys = materialise(keys.join(size, ["band", "slice"]), "bands")
    cold = keys.where(F.col("n") <= hot).select("h", "band", "slice", F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("subslice"))
    # the bits besides a crowded slice still differ in at most `distance` places
    width = 64 // (distance + 1)
    warm = keys.where(F.col("n") > hot).withColumn("k", F.explode(bands("rest", distance, 64 - width))).select("h", "band", "slice", F.col("k.band").alias("sub"), F.col("k.slice").alias("subslice"))
    x = cold.unionByName(warm)
    y = x.withColumnRenamed("h", "g")
    pairs = x.join(y, ["band", "slice", "sub", "subslice"]).where("h < g")
    return pairs.withColumn("distance", hamming("h", "g")).where(F.col("distance") <= distance).select(F.col("h").alias("a"), F.col("g").alias("b"), "distance").distinct()


def near_clones(ix: CodeIndex, distance: int) -> DataFrame:
    """`id, path, line, name, component, distance`: symbols with a near clone under another path.

    `distance` is the least Hamming distance in the group. Equal hashes are linked
    through their value, so a group of copies needs no pairs.
    """
    f = materialise(fingerprints(ix).where("simhash is not null").select("id", "file_id", "name", "line", F.col("simhash").alias("h")), "simhash")
    at = f.join(ix.scope, "file_id")
    spread = at.groupBy("h").agg(F.countDistinct("path").alias("paths"), F.min("path").alias("p0"))
    pairs = near_pairs(f.select("h"), distance)
    # two values link symbols of different paths unless both lie under one same path only
    pa, pb = (spread.select(F.col("h").alias(c), F.col("paths").alias(f"n_{c}"), F.col("p0").alias(f"p_{c}")) for c in "ab")
    linked = pairs.join(pa, "a").join(pb, "b").where("n_a > 1 or n_b > 1 or p_a != p_b")
    same = spread.where("paths > 1").select(F.col("h").alias("a"), F.col("h").alias("b"), F.lit(0).alias("distance"))
    groups = components(linked.select("a", "b"), "a", "b")
    value = groups.select(F.col("node").alias("h"), "component").unionByName(same.join(groups, same.a == groups.node, "left_anti").select(F.col("a").alias("h"), F.col("a").alias("component")))
    links = linked.select("a", "distance").unionByName(same.select("a", "distance"))
    least = links.join(value, links.a == value.h).groupBy("component").agg(F.min("distance").alias("distance"))
    members = at.groupBy("id", "h", "name", "line").agg(F.min("path").alias("path"))
    return members.join(value, "h").join(least, "component").select("id", "path", "line", "name", "component", "distance")


def dominant_model(embeddings: DataFrame) -> DataFrame:
    """The model with most vectors; ties go to the first name."""
    n = embeddings.groupBy("model").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "model").limit(1).select("model")


def semantic_pairs(items: DataFrame, distance: float, k: int = 20, block: int = 2048, max_pivots: int = 1000, by_id: bool = False) -> DataFrame:
    """`a, b, distance`: the `k` nearest others of each item(id, v) within a cosine distance; `by_id`: the k smallest ids.

    Vectors of the most frequent length take part (of each model, where items have one).

    Exact. Items go to blocks around pivots (a bounded sample of the items); two
    blocks are compared, by one matrix product, only if the angle between their
    pivots leaves room for a pair that is near enough (the triangle inequality). A
    task holds two blocks and keeps their own top k. Null and all-zero vectors have
    no neighbours. Where the angles leave room everywhere, as they do for wide clusters
    in many dimensions, this is a comparison of all blocks.
    """
    import numpy as np
    import pandas as pd

    if "model" in items.columns:
        models = [r["model"] for r in items.where("model is not null").select("model").distinct().orderBy("model").limit(1001).collect()]
        if len(models) > 1000:
            raise ValueError("more than 1000 models")
        parts = [semantic_pairs(items.where(F.col("model") == m).select("id", "v"), distance, k, block, max_pivots, by_id) for m in models]
        return reduce(DataFrame.unionByName, parts) if parts else items.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    items = items.join(F.broadcast(items.where("v is not null").agg(F.mode(F.size("v"), True).alias("_size"))), F.size("v") == F.col("_size")).select("id", "v")
    n = items.count()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    live = materialise(items.where("id is not null and v is not null").select("id", "v").where(norm > 0), "items")
    pivots = max(1, min(max_pivots, -(-n // block)))
    sample = live.select("v").where(F.rand(5) < min(1.0, 20 * pivots / max(n, 1))).limit(pivots).collect() or live.select("v").limit(1).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    centres = unit(np.array([r["v"] for r in sample], float)) if sample else np.zeros((0, 1))
    angle = lambda c: np.arccos(np.clip(c, -1, 1))
    shared = live.sparkSession.sparkContext.broadcast(centres)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                a = angle(unit(np.stack(pdf["v"].to_numpy()).astype(float)) @ shared.value.T)
                near = a.argmin(1)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "pivot": near, "angle": a[np.arange(len(a)), near]})

    placed = materialise(live.mapInPandas(place, "id bigint, v array<double>, pivot int, angle double"), "placed")
    info = {r["pivot"]: (r["n"], r["far"]) for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("angle").alias("far")).collect()}
    reach = float(np.arccos(np.clip(1 - distance, -1, 1))) + 1e-6
    apart = angle(centres @ centres.T) if len(centres) else np.zeros((0, 0))
    parts = {p: -(-n_ // block) for p, (n_, _) in info.items()}
    mates = {p: [q for q in info if apart[p, q] <= reach + info[p][1] + info[q][1]] for p in info}
    plan = live.sparkSession.sparkContext.broadcast((parts, mates))

    def route(batches):
        parts, mates = plan.value
        for pdf in batches:
            for p, g in pdf.groupby("pivot"):
                sub = np.array([(int(i) * 2654435761 >> 7) % parts[p] for i in g["id"]])
                for q in mates[p]:
                    for t in range(parts[q]):
                        own, other = p * 1_000_000 + sub, q * 1_000_000 + t
                        yield pd.DataFrame({"x": np.minimum(own, other), "y": np.maximum(own, other), "id": g["id"], "v": g["v"], "home": own})

    routed = placed.mapInPandas(route, "x bigint, y bigint, id bigint, v array<double>, home bigint")

    order_in = ["a", "b"] if by_id else ["a", "distance", "b"]

    def compare(key, a, b):
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        if a.empty or b.empty:
            return none
        x, y = (unit(np.stack(t["v"].to_numpy())) for t in (a, b))
        ia, ib = a["id"].to_numpy(), b["id"].to_numpy()
        parts = [none]
        for at in range(0, len(x), 256):
            d = 1 - x[at : at + 256] @ y.T
            d[ia[at : at + 256, None] == ib[None, :]] = np.inf
            r, c = np.nonzero(d < distance)
            parts.append(pd.DataFrame({"a": ia[at + r], "b": ib[c], "distance": d[r, c]}))
        both = pd.concat([p for p in parts if len(p)] or [none])
        if key[0] != key[1]:
            both = pd.concat([both, both.rename(columns={"a": "b", "b": "a"})[["a", "b", "distance"]]])
        return both.sort_values(order_in).groupby("a").head(k)

    # new columns on either side: a self-cogroup below a union mixes them up otherwise
    left, right = (routed.where(F.col("home") == F.col(c)).select(*[F.expr(n).alias(n) for n in routed.columns]) for c in "xy")
    found = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(compare, "a bigint, b bigint, distance double")
    w = Window.partitionBy("a").orderBy(*order_in[1:])
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def semantic_clusters(ix: CodeIndex, embeddings: DataFrame, distance: float = 0.1, k: int = 20) -> DataFrame:
    """`id, path, name, line, cluster, nearest` of functions whose first blocks' vectors chain together.

    Vectors of the most frequent model; paths with `test` are left out.
    """
    e = embeddings.where("vector is not null and content_hash is not null").select("content_hash", "model", "vector").dropDuplicates(["content_hash", "model"])
    e = e.join(F.broadcast(dominant_model(e)), "model", "left_semi")
    size = e.agg(F.mode(F.size("vector"), True).alias("size"))
    e = e.join(F.broadcast(size), F.size("vector") == F.col("size"))
    home = ix.scope.where(~like("path", "%test%")).groupBy("file_id").agg(F.min("path").alias("path"))
    s = ix.symbols.where(F.col("kind").isin(*CODE)).join(home, "file_id").join(ix.blocks.where("block_index = 0").select(F.col("symbol_id").alias("id"), F.col("content_hash").alias("ch")), "id").join(e.select(F.col("content_hash").alias("ch"), "vector"), "ch")
    s = materialise(s.select("id", "path", "name", "line", F.col("vector").alias("v")).dropDuplicates(["id"]), "code-vectors")
    pairs = materialise(semantic_pairs(s.select("id", "v"), distance, k), "semantic-pairs")
    group = components(pairs, "a", "b")
    near = pairs.select(F.col("a").alias("id"), "distance").unionByName(pairs.select(F.col("b").alias("id"), "distance")).groupBy("id").agg(F.min("distance").alias("nearest"))
    return s.join(group.select(F.col("node").alias("id"), F.col("component").alias("cluster")), "id").join(near, "id").select("id", "path", "name", "line", "cluster", "nearest")
