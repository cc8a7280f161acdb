"""Problem 6: the most similar vectors of every vector, by pruned graphs.

Vectors are put into overlapping shards of bounded size: each goes to its few nearest
centres, so that near vectors meet in a shard. Each shard gets a directed graph:
greedy searches propose neighbours, and robust pruning with a relaxed distance keeps
edges of different directions, so that few edges lead everywhere. Every vector then
runs a beam search in the graphs of its shards, starting from itself; the searches'
results are merged, and what one vector finds is proposed to the other as well.

A vector's copies are a fixed number, whatever the number of shards: traffic and work
grow with the number of vectors. Shards that are still too large are cut again, each by
centres of its own members, so that no list of all centres is needed at once.

Equal vectors are one point of the graphs and one query: a class, named by its
smallest id. The classes found are turned into ids afterwards, own class first.

Vectors of unit length; for these cosine order and distance order agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lithoscope.session import materialise

#: Edges per vector, candidates per search while building and afterwards, relaxation of the pruning distance.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 24, 40, 32, 1.2
#: Bytes of the vectors of one shard. A graph's cost per vector grows with the logarithm of its size,
#: copies cost a multiple: shards are as large as a task holds with ease.
SHARD_BYTES = 32 << 20
#: Bytes of centres that one step of cutting sends to the tasks; more centres mean more steps.
CENTRE_BYTES = 64 << 20
#: Most centres that one shard is cut by, and most times that a shard is cut again.
MOST_CENTRES, MOST_CUTS = 512, 6


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int):
    """Best-first searches of all queries at once: (n, beam) places and similarities, best first.

    graph: (n, degree) places, -1 for none. start: places to begin at, for all queries
    or (two dimensions) for each. Every search expands its best candidate that it hasn't
    expanded yet, until all of its `beam` best are expanded.
    """
    n = len(queries)
    start = np.broadcast_to(start, (n, start.shape[-1]))[:, :beam]
    k = start.shape[1]
    out_ids, out_sim = np.full((n, beam), -1, np.int64), np.full((n, beam), -np.inf, np.float32)
    ids, sim, done = out_ids.copy(), out_sim.copy(), np.ones((n, beam), bool)
    ids[:, :k], sim[:, :k], done[:, :k] = start, np.matmul(x[start], queries[:, :, None])[:, :, 0], False
    live, q = np.arange(n), queries
    while len(live):
        s = np.where(done, -np.inf, sim)
        rows = np.arange(len(live))
        at = s.argmax(1)
        more = s[rows, at] > -np.inf
        if not more.all():
            out_ids[live[~more]], out_sim[live[~more]] = ids[~more], sim[~more]
            live, at, ids, sim, done, q = live[more], at[more], ids[more], sim[more], done[more], q[more]
            rows = np.arange(len(live))
            if not len(live):
                break
        done[rows, at] = True
        new = graph[ids[rows, at]]
        score = np.matmul(x[np.maximum(new, 0)], q[:, :, None])[:, :, 0]
        score[(new < 0) | (score <= sim.min(1)[:, None]) | (new[:, :, None] == ids[:, None, :]).any(2)] = -np.inf
        every = np.concatenate([sim, score], 1)
        keep = np.argpartition(-every, beam - 1, 1)[:, :beam]
        rows = rows[:, None]
        sim, ids = every[rows, keep], np.concatenate([ids, new], 1)[rows, keep]
        ids[sim == -np.inf] = -1
        done = np.concatenate([done, np.zeros(new.shape, bool)], 1)[rows, keep] | (ids < 0)
    order = np.argsort(-out_sim, 1, kind="stable")
    return np.take_along_axis(out_ids, order, 1), np.take_along_axis(out_sim, order, 1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float, block: int = 1024) -> np.ndarray:
    """For each point, `degree` of its candidates: the nearest, then each that no kept one is `alpha` times nearer to."""
    out = np.full((len(points), degree), -1, np.int64)
    for a in range(0, len(points), block):
        p = points[a : a + block]
        c = np.where(candidates[a : a + block] == p[:, None], -1, candidates[a : a + block])
        c = -np.sort(-c, 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        v = x[np.maximum(c, 0)]
        d = 2 - 2 * np.matmul(v, x[p][:, :, None])[:, :, 0]
        d[c < 0] = np.inf
        between = alpha * alpha * (2 - 2 * np.matmul(v, v.transpose(0, 2, 1)))
        rows = np.arange(len(p))
        for k in range(degree):
            best = d.argmin(1)
            ok = np.isfinite(d[rows, best])
            if not ok.any():
                break
            out[a : a + block][ok, k] = c[rows[ok], best[ok]]
            drop = between[rows, best] <= d
            drop[rows, best] = True
            d[drop] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7):
    """The graph of one shard and its entry points: search, prune and back edges, in growing batches.

    Back edges fill a margin of free places; a vector whose margin is full is pruned
    again, with all of its back edges as candidates.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    if n <= degree + 1:
        every = np.tile(np.arange(n), (n, 1))
        return np.where(every == np.arange(n)[:, None], -1, every), np.arange(n)
    width = 2 * degree
    graph = np.full((n, width), -1, np.int64)
    graph[:, :degree] = rng.integers(0, n, (n, degree))
    fill = np.full(n, degree)
    middle = np.argsort(-(x @ x.mean(0)))[:1]
    entry = np.unique(np.concatenate([middle, rng.choice(n, min(n, 8), replace=False)]))

    def put(points, edges):
        graph[points] = -1
        graph[points, :degree] = edges
        fill[points] = (edges >= 0).sum(1)

    order, lo, size = rng.permutation(n), 0, 64
    while lo < n:
        points = order[lo : lo + size]
        lo, size = lo + size, min(2048, size * 2)
        found, _ = beam_search(x, graph, x[points], entry, beam)
        put(points, robust_prune(x, points, np.concatenate([found, graph[points]], 1), degree, alpha))
        # back edges, grouped by their new source
        src, dst = np.repeat(points, width), graph[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, first, count = np.unique(dst, return_index=True, return_counts=True)
        rank = np.arange(len(dst)) - np.repeat(first, count)
        full = fill[heads] + count > width
        fits = np.repeat(~full, count)
        graph[dst[fits], (rank + fill[dst])[fits]] = src[fits]
        fill[heads[~full]] += count[~full]
        # the fullest last, so that rows of candidates of like lengths are pruned together
        crowded = np.flatnonzero(full)[np.argsort(count[full], kind="stable")]
        for a in range(0, len(crowded), 256):
            part = crowded[a : a + 256]
            extra = np.full((len(part), int(count[part].max())), -1, np.int64)
            at = np.concatenate([np.arange(first[j], first[j] + count[j]) for j in part])
            extra[np.repeat(np.arange(len(part)), count[part]), rank[at]] = src[at]
            put(heads[part], _prune_all(x, heads[part], np.concatenate([graph[heads[part]], extra], 1), degree, alpha))
    over = np.flatnonzero(fill > degree)
    out = graph[:, :degree].copy()
    out[over] = robust_prune(x, over, graph[over], degree, alpha)
    return out, entry


def _prune_all(x, points, candidates, degree, alpha, most: int = 256):
    """`robust_prune` of any number of candidates, a bounded number at a time."""
    while candidates.shape[1] > most:
        kept = robust_prune(x, points, candidates[:, :most], degree, alpha)
        candidates = np.concatenate([kept, candidates[:, most:]], 1)
    return robust_prune(x, points, candidates, degree, alpha)


def centres(sample: np.ndarray, k: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of a sample, in unit length."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        order = np.argsort(near, kind="stable")
        held, first = np.unique(near[order], return_index=True)
        s = np.add.reduceat(sample[order], first, 0)
        c[held] = s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def usable(vectors: DataFrame, id_col: str, vec_col: str, model_col: str, dims: dict[str, int]) -> DataFrame:
    """`model, id, v`: each vector that takes part once, in unit length."""

    def run(batches):
        for pdf in batches:
            n = pdf["v"].map(len)
            for model, g in pdf[n == pdf["model"].map(dims)].groupby("model"):
                v = np.stack(g["v"].to_numpy()).astype(np.float64)  # null numbers are NaN here
                norm = np.sqrt((v * v).sum(1))
                ok = np.isfinite(norm) & (norm > 0)
                if ok.any():
                    yield pd.DataFrame({"model": model, "id": g["id"].to_numpy()[ok], "v": list(v[ok] / norm[ok, None])})

    rows = vectors.select(F.col(f"`{model_col}`").alias("model"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where("model is not null and id is not null and v is not null")
    return rows.mapInPandas(run, "model string, id bigint, v array<double>").dropDuplicates(["model", "id"])


def model_sizes(vectors: DataFrame, vec_col: str, model_col: str, max_models: int = 1000) -> dict[str, int]:
    """The length of each model's vectors: the most frequent one (ties: the longest)."""
    n = vectors.where(f"`{vec_col}` is not null").groupBy(F.col(f"`{model_col}`").alias("model"), F.size(f"`{vec_col}`").alias("size")).agg(F.count("*").alias("n"))
    rows = n.groupBy("model").agg(F.max_by("size", F.struct("n", "size")).alias("size")).where("model is not null").limit(max_models + 1).collect()
    if len(rows) > max_models:
        raise ValueError(f"more than {max_models} models")
    return {r["model"]: r["size"] for r in rows}


def shards(rows: DataFrame, shard_rows: int | None, copies: int, least: float, sample_rows: int) -> DataFrame:
    """`model, cell, id, v`: rows(model, id, v) in overlapping shards of about `shard_rows` vectors (else SHARD_BYTES).

    A model of more vectors is cut: centres are fitted to a sample of at most about
    `sample_rows` of its vectors, and each vector goes to its `copies` nearest ones
    (two, where a shard is cut again). A centre that no vector within the angle of
    `least` can have for its nearest is left out. Sizes and centres of the shards to
    be cut come to the driver, at most CENTRE_BYTES at a time.
    """
    spark = rows.sparkSession
    live = rows.select("model", F.lit("").alias("cell"), "id", "v")
    theta = 2 * float(np.arccos(least))
    while True:
        size = live.groupBy("model", "cell").agg(F.count("*").alias("n"), F.first(F.size("v")).alias("dims"))
        limit = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(1024), F.floor(SHARD_BYTES / (8 * F.col("dims"))))
        depth = F.size(F.split("cell", "/"))
        per = F.when(F.col("cell") == "", copies).otherwise(2)
        k = F.least(F.lit(MOST_CENTRES), F.greatest(3 * per, F.ceil(F.col("n") * per / limit))).cast("int")
        crowded = size.where((F.col("n") > limit) & (depth <= MOST_CUTS)).select("model", "cell", "n", per.cast("int").alias("per"), k.alias("k"), (k * F.col("dims") * 4).cast("bigint").alias("bytes"))
        room = F.sum("bytes").over(Window.orderBy("model", "cell").rowsBetween(Window.unboundedPreceding, -1))
        todo = crowded.withColumn("room", F.coalesce(room, F.lit(0))).where(F.col("room") < CENTRE_BYTES).limit(CENTRE_BYTES // 256).collect()
        if not todo:
            return live
        plan = spark.createDataFrame([(r["model"], r["cell"], r["k"], min(1.0, sample_rows / r["n"])) for r in todo], "model string, cell string, k int, share double")
        chosen = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < F.col("share") * (1 << 20)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(pdf.sort_values("id")["v"].to_numpy()).astype(np.float32)
            got = centres(x, min(int(pdf["k"].iloc[0]), len(x)))
            return pd.DataFrame({"model": [pdf["model"].iloc[0]], "cell": [pdf["cell"].iloc[0]], "centres": [got.tobytes()]})

        fitted = live.join(F.broadcast(plan), ["model", "cell"]).where(chosen).groupBy("model", "cell").applyInPandas(fit, "model string, cell string, centres binary").collect()
        per_of = {(r["model"], r["cell"]): r["per"] for r in todo}
        table = {(r["model"], r["cell"]): (per_of[r["model"], r["cell"]], bytes(r["centres"])) for r in fitted}
        shared = spark.sparkContext.broadcast(table)

        def place(batches):
            for pdf in batches:
                for (model, cell), g in pdf.groupby(["model", "cell"]):
                    if (model, cell) not in shared.value:
                        yield g
                        continue
                    count, raw = shared.value[model, cell]
                    v = np.stack(g["v"].to_numpy()).astype(np.float32)
                    angle = np.arccos(np.clip(v @ np.frombuffer(raw, np.float32).reshape(-1, v.shape[1]).T, -1, 1))
                    count = min(count, angle.shape[1])
                    near = np.argpartition(angle, count - 1, 1)[:, :count]
                    far = np.take_along_axis(angle, near, 1)
                    row, col = np.nonzero(far <= far.min(1, keepdims=True) + theta)
                    out = g.iloc[row].copy()
                    out["cell"] = [f"{cell}/{j}" for j in near[row, col]]
                    yield out

        live = materialise(live.mapInPandas(place, live.schema), "shards")


def nearest(vectors: DataFrame, id_col: str, vec_col: str = "vector", model_col: str = "model", k: int = 5, least: float = 0.85, shard_rows: int | None = None, copies: int = 3, sample_rows: int = 20_000) -> DataFrame:
    """`model, id, other, similarity, rank`: up to `k` nearest others of each vector, with cosine of at least `least`.

    Ties go to the smaller id. A model of up to `shard_rows` different vectors (SHARD_BYTES,
    where it isn't given) is one graph; larger ones are cut into overlapping shards (see `shards`). Every vector is
    indexed and queried. Found similarities are computed exactly; the recall of the
    searches is measured in the tests. Ties are exact within a shard: equal vectors are
    indexed once, and a search whose beam ends within a tie looks at its whole graph.

    Defined results: null, all-zero and wrong-length vectors (the right length of a
    model is its most frequent one), vectors with null or NaN numbers, and null ids
    or models take no part; rows of one model and id count once; a vector with no
    other near enough has no row; an empty table gives no rows.
    """
    dims = model_sizes(vectors, vec_col, model_col)
    hash_ = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), F.col("v")).alias("b"))
    every = materialise(usable(vectors, id_col, vec_col, model_col, dims).withColumn("h", hash_), "vectors")
    classes = materialise(every.groupBy("model", "h").agg(F.min("id").alias("id"), F.first("v").alias("v")), "classes")
    owned = every.select("model", "h", "id").join(classes.select("model", "h", F.col("id").alias("class")), ["model", "h"]).select("model", "class", "id")
    placed = shards(classes.select("model", "id", "v"), shard_rows, copies, least, sample_rows)
    found = placed.groupBy("model", "cell").applyInPandas(_search(k, least), "model string, id bigint, other bigint, similarity double")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), F.col("other").alias("other")))), 1, k)
    merged = found.repartition("model", "id").groupBy("model", "id", "other").agg(F.max("similarity").alias("similarity")).groupBy("model", "id").agg(F.explode(best).alias("e"))
    return _expand(merged.select("model", "id", "e.other", (-F.col("e.minus")).alias("similarity")), materialise(owned, "members"), k)


def _expand(found: DataFrame, owned: DataFrame, k: int) -> DataFrame:
    """The ids' nearest from the classes' nearest: found(model, id, other, similarity), owned(model, class, id).

    The k + 1 smallest ids of a class are enough: an id of any other place has k
    before it at the same similarity. One list per class serves all its members.
    """
    smallest = Window.partitionBy("model", "class").orderBy("id")
    first = owned.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    own = first.select("model", "class", F.struct(F.lit(0).alias("far"), F.lit(-1.0).alias("minus"), F.col("id").alias("other")).alias("entry"))
    near = found.select("model", F.col("id").alias("asks"), F.col("other").alias("class"), "similarity").join(first, ["model", "class"])
    near = near.select("model", F.col("asks").alias("class"), F.struct(F.lit(1).alias("far"), (-F.col("similarity")).alias("minus"), F.col("id").alias("other")).alias("entry"))
    lists = own.unionByName(near).groupBy("model", "class").agg(F.slice(F.sort_array(F.collect_list("entry")), 1, k + 1).alias("entries"))
    got = owned.join(lists, ["model", "class"]).select("model", "id", F.posexplode(F.slice(F.filter("entries", lambda x: x["other"] != F.col("id")), 1, k)).alias("at", "entry"))
    return got.select("model", "id", F.col("entry.other").alias("other"), (-F.col("entry.minus")).alias("similarity"), (F.col("at") + 1).alias("rank"))


def _ties(q: np.ndarray, exact: np.ndarray, rows: np.ndarray, ids: np.ndarray, qid: np.ndarray, k: int):
    """(rows, places) of the k nearest of some queries among all vectors of a graph, ties to the smaller id."""
    s = q[rows] @ exact.T
    s[ids == qid[rows][:, None]] = -np.inf
    k = min(k, s.shape[1])
    last = -np.partition(-s, k - 1, 1)[:, k - 1]
    row, place = np.nonzero((s >= last[:, None] - 1e-9) & np.isfinite(s))
    value = np.minimum(np.einsum("ij,ij->i", q[rows[row]], exact[place]), 1.0)
    order = np.lexsort((ids[place], -value, row))
    row, place = row[order], place[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return rows[row[keep]], place[keep]


def _search(k: int, least: float):
    columns = ["model", "id", "other", "similarity"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy(np.int64)
        exact = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        x = exact.astype(np.float32)
        graph, _ = build_graph(x)
        beam = max(BEAM, 2 * (k + 1))
        parts = []
        for a in range(0, len(ids), 4096):
            own = np.arange(a, min(a + 4096, len(ids)))
            place, sim = beam_search(x, graph, x[own], own[:, None], beam)
            # a beam that ends within a tie with the last place wanted: look at the whole graph
            last = min(k, beam - 1)
            tied = np.isfinite(sim[:, -1]) & (sim[:, last] >= least - 1e-4) & (sim[:, -1] >= sim[:, last] - 1e-5)
            row, col = np.nonzero((place >= 0) & (sim >= least - 1e-4) & ~tied[:, None])
            parts.append((own[row], place[row, col]))
            again = own[tied]
            for b in range(0, len(again), 256):
                parts.append(_ties(exact, exact, again[b : b + 256], ids, ids, k))
        row, other = (np.concatenate(c) for c in zip(*parts))
        # what one finds is proposed to the other
        both = np.unique(np.concatenate([row * len(ids) + other, other * len(ids) + row]))
        row, other = both // len(ids), both % len(ids)
        row, other = row[row != other], other[row != other]
        value = np.minimum(np.einsum("ij,ij->i", exact[row], exact[other]), 1.0)
        near = value >= least - 1e-9
        row, other, value = row[near], other[near], value[near]
        order = np.lexsort((ids[other], -value, row))
        row, other, value = row[order], other[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out = pd.DataFrame({"id": ids[row[keep]], "other": ids[other[keep]], "similarity": value[keep]})
        out.insert(0, "model", pdf["model"].iloc[0])
        return out[columns]

    return run


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """`id_a, id_b` (id_a < id_b): pairs of which one is among the other's nearest."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
