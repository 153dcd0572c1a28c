"""Indexes of vectors: partitions by k-means, product codes, pruned neighbour graphs, blocked pairs. What is fitted is fitted to a bounded sample; every vector is indexed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.operators.ranking import top_per_group
from tessaline.operators.retrieval import cosine_top
from tessaline.runtime import cut, nothing

#: Vectors that centroids and codebooks are fitted to, chosen by a hash of the id.
SAMPLE = 65_536


def _sample(rows: DataFrame, key: str, vector: str) -> np.ndarray:
    got = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toPandas()[vector]
    return np.stack(got.to_numpy()) if len(got) else np.zeros((0, 1))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    return np.concatenate([(points[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(points), 4096)] or [np.zeros(0, int)])


def k_means(points: np.ndarray, k: int, rounds: int = 20, seed: int = 3) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = points[r.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        count = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        filled = count > 0
        moved = centres.copy()
        moved[filled] = sums[filled] / count[filled, None]
        if np.allclose(moved, centres, atol=1e-9):
            break
        centres = moved
    return centres


def medoids(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(label, key) of the member nearest to each label's mean; the means are sums per dimension, no group is collected."""
    entries = rows.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("m"))
    means = entries.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    far = F.aggregate(F.zip_with(vector, "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    scored = rows.join(F.broadcast(means) if means.count() <= 100_000 else means, label).select(label, key, F.round(far, 9).alias("far"))
    return scored.groupBy(label).agg(F.min(F.struct("far", key)).alias("b")).select(label, f"b.{key}")


def partitioned(rows: DataFrame, key: str, vector: str, cells: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(rows with `cell`, centroids): the square root of n cells unless given."""
    n = rows.count()
    points = _sample(rows, key, vector)
    k = cells or max(1, int(np.ceil(n**0.5)))
    centres = k_means(points, min(k, max(1, len(points)))) if len(points) else np.zeros((1, 1))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=nearest(np.stack(b[vector].to_numpy()), centres).astype(np.int32) if len(b) else pd.Series([], dtype="int32"))

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", cell int"
    return rows.where(F.col(vector).isNotNull()).mapInPandas(place, schema), centres


def probed(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, probes: int = 10) -> DataFrame:
    """(query_id, key, similarity, rank) of the k best of each query's `probes` nearest cells: queries are sent to cells, a cell is scored where it lies."""
    placed, centres = partitioned(rows, key, vector)
    count = min(probes, len(centres))
    kinds, q_kind = dict(rows.dtypes), dict(queries.dtypes)["query_id"]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = 0.5 * (centres * centres).sum(1)
        for b in batches:
            if b.empty:
                continue
            near = np.argsort(half - np.stack(b.query_vector.to_numpy()) @ centres.T, axis=1, kind="stable")[:, :count]
            yield pd.DataFrame({"query_id": np.repeat(b.query_id.to_numpy(), count), "q": [v for v in b.query_vector for _ in range(count)], "cell": near.ravel().astype(np.int32)})

    sent = queries.select("query_id", "query_vector").mapInPandas(ask, f"query_id {q_kind}, q array<double>, cell int")

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return nothing("query_id", key, "similarity")
        x = x.sort_values(key)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        s = unit(np.stack(y.q.to_numpy())) @ unit(np.stack(x[vector].to_numpy())).T
        s[y.query_id.to_numpy()[:, None] == x[key].to_numpy()[None, :]] = -np.inf
        top = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(y)), top.shape[1])
        found = pd.DataFrame({"query_id": y.query_id.to_numpy()[at], key: x[key].to_numpy()[top.ravel()], "similarity": s[at, top.ravel()]})
        return found[np.isfinite(found.similarity)]

    # A cell with many vectors is dealt to several tasks; each keeps k.
    sizes = cut(placed).select(key, vector, "cell")
    parts = max(1, -(-sizes.count() // (len(centres) * 16_384)))
    held = sizes.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    spread = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    scored = held.groupBy("cell", "part").cogroup(spread.groupBy("cell", "part")).applyInPandas(score, f"query_id {q_kind}, {key} {kinds[key]}, similarity double")
    return top_per_group(scored.withColumn("_s", F.round("similarity", 9)), ["query_id"], [F.col("_s").desc(), F.col(key)], k).drop("_s")


def product_books(rows: DataFrame, key: str, vector: str, parts: int = 8, words: int = 256) -> np.ndarray:
    """(parts, words, dimensions / parts) codewords, each part fitted by itself."""
    points = _sample(rows, key, vector)
    return np.stack([k_means(x, words) if len(x) >= words else np.resize(x, (words, x.shape[1])) for x in np.split(points, parts, axis=1)])


def encoded(rows: DataFrame, books: np.ndarray, vector: str) -> DataFrame:
    """The rows with `codes`, a byte for each part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            x = np.split(np.stack(b[vector].to_numpy()), len(books), axis=1)
            codes = np.stack([nearest(part, book) for part, book in zip(x, books, strict=True)], 1).astype(np.uint8)
            yield b.assign(codes=[c.tobytes() for c in codes])

    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", codes binary")


def decoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows with the vector that their `codes` stand for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            codes = np.frombuffer(b"".join(b.codes), np.uint8).reshape(len(b), -1)
            yield b.assign(decoded=list(np.concatenate([book[codes[:, m]] for m, book in enumerate(books)], 1)))

    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", decoded array<double>")


def distance_table(query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(parts, words): the squared distance of each part of a query to each codeword."""
    parts = np.split(query, len(books))
    return np.stack([((book - part) ** 2).sum(1) for part, book in zip(parts, books, strict=True)])


def by_table(codes: DataFrame, queries: DataFrame, books: np.ndarray, key: str, k: int) -> DataFrame:
    """(query_id, key, distance, rank) of the k nearest by table lookup; queries in blocks, each with all parts of the codes."""
    q_kind, kind = dict(queries.dtypes)["query_id"], dict(codes.dtypes)[key]
    n, m = max(1, -(-codes.count() // 65_536)), max(1, -(-queries.count() // 512))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(c - 1).cast("bigint")))
    left = codes.select(key, "codes", F.pmod(F.xxhash64(key), F.lit(n)).alias("a")).select("*", every(m).alias("b"))
    right = queries.select("query_id", "query_vector", F.pmod(F.xxhash64("query_id"), F.lit(m)).alias("b")).select("*", every(n).alias("a"))

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return nothing("query_id", key, "distance")
        x = x.sort_values(key)
        c = np.frombuffer(b"".join(x.codes), np.uint8).reshape(len(x), -1)
        out = []
        for i, v in zip(y.query_id, y.query_vector, strict=True):
            table = distance_table(np.asarray(v), books)
            d = table[np.arange(len(books)), c].sum(1)
            d[x[key].to_numpy() == i] = np.inf
            top = np.argsort(np.round(d, 9), kind="stable")[:k]
            out.append(pd.DataFrame({"query_id": i, key: x[key].to_numpy()[top], "distance": d[top]}))
        found = pd.concat(out)
        return found[np.isfinite(found.distance)]

    scored = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(score, f"query_id {q_kind}, {key} {kind}, distance double")
    return top_per_group(scored.withColumn("_d", F.round("distance", 9)), ["query_id"], [F.col("_d"), F.col(key)], k).drop("_d")


def prune(own: np.ndarray, ids: np.ndarray, points: np.ndarray, degree: int, alpha: float) -> list:
    """Of the candidates in the order of distance those to which no kept one is nearer than 1 / alpha of their distance."""
    far = ((points - own) ** 2).sum(1)
    order = np.lexsort((ids, far))
    kept: list[int] = []
    for i in order:
        if all(alpha * ((points[i] - points[j]) ** 2).sum() > far[i] for j in kept):
            kept.append(int(i))
            if len(kept) == degree:
                break
    return [ids[i] for i in kept]


def neighbour_graph(rows: DataFrame, key: str, vector: str, degree: int = 32, candidates: int = 75, alpha: float = 1.2) -> DataFrame:
    """(src, dst): a directed graph over all vectors; candidates come from the probed partitions, each list is pruned where it lies, and edges also run back."""
    rows = cut(rows.select(key, vector).where(F.col(vector).isNotNull()))
    queries = rows.select(F.col(key).alias("query_id"), F.col(vector).alias("query_vector"))
    near = probed(rows, queries, key, vector, candidates).select(F.col("query_id").alias("src"), F.col(key).alias("dst"))
    other = rows.select(F.col(key).alias("dst"), F.col(vector).alias("w"))
    lists = near.join(other, "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "w")).alias("c")).join(rows.select(F.col(key).alias("src"), F.col(vector).alias("v")), "src")
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for s, c, v in zip(b.src, b.c, b.v, strict=True):
                kept = prune(np.asarray(v), np.array([x["dst"] for x in c]), np.stack([np.asarray(x["w"]) for x in c]), degree, alpha)
                out += [(s, d) for d in kept]
            yield pd.DataFrame(out, columns=["src", "dst"])

    one_way = cut(lists.mapInPandas(run, f"src {kind}, dst {kind}"))
    return cut(one_way.union(one_way.select("dst", "src")).distinct())


def greedy(rows: DataFrame, edges: DataFrame, queries: DataFrame, key: str, vector: str, k: int, width: int = 24, rounds: int = 12) -> DataFrame:
    """(query_id, key, similarity, rank) by best-first walks, all queries at once: each round the unvisited of a query's `width` best are opened."""
    from tessaline.functions.vectors import cosine

    rows = rows.select(key, vector)
    # The walks begin at the best of the members nearest to the means of the cells, the root of n of them.
    entry = cut(medoids(partitioned(rows, key, vector)[0], key, "cell", vector).select(key))
    score = lambda pairs: pairs.join(rows, key).join(queries, "query_id").select("query_id", key, F.round(cosine(F.col(vector), F.col("query_vector")), 9).alias("s"))
    pool = cut(score(queries.select("query_id").crossJoin(F.broadcast(entry))).withColumn("open", F.lit(True)))
    for _ in range(rounds):
        best = W.partitionBy("query_id").orderBy(F.col("s").desc(), key)
        pool = pool.withColumn("r", F.row_number().over(best)).where(F.col("r") <= width)
        front = pool.where("open")
        fresh = front.select("query_id", F.col(key).alias("src")).join(edges, "src").select("query_id", F.col("dst").alias(key)).distinct()
        fresh = cut(score(fresh.join(pool.select("query_id", key), ["query_id", key], "left_anti")))
        if fresh.isEmpty():
            break
        pool = cut(pool.select("query_id", key, "s", F.lit(False).alias("open")).unionByName(fresh.withColumn("open", F.lit(True))))
    found = pool.where(F.col("query_id") != F.col(key)).withColumnRenamed("s", "similarity")
    return top_per_group(found, ["query_id"], [F.col("similarity").desc(), F.col(key)], k).select("query_id", key, "similarity", "rank")


#: Vectors in a block of a label's product.
BLOCK = 4_096


def pairs_within(rows: DataFrame, key: str, label: str, vector: str, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of one label with a cosine of `least` and more. A label's vectors are dealt to blocks and each two blocks are multiplied in
    one task, so a large label is many tasks and none holds it."""
    rows = rows.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(vector).alias("v")).where("k is not null and l is not null and v is not null")
    sizes = rows.groupBy("l").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = cut(rows.join(sizes, "l").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")))
    kind = dict(rows.dtypes)["k"]
    left = placed.select("l", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), "k", "v")
    # Other names on the other side: both come from one table.
    right = placed.select(F.col("l").alias("m"), F.col("block").alias("t"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("s"), F.col("k").alias("other"), F.col("v").alias("w"))

    def multiply(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return nothing("a", "b", "similarity")
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        s = unit(np.stack(p.v.to_numpy())) @ unit(np.stack(q.w.to_numpy())).T
        i, j = np.nonzero(s >= least)
        a, b = p.k.to_numpy()[i], q.other.to_numpy()[j]
        # Inside one block each pair is met twice.
        ok = (a < b) if p.x.iloc[0] == p.y.iloc[0] else np.ones(len(a), bool)
        a, b, sim = a[ok], b[ok], s[i, j][ok]
        swap = a > b
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "similarity": sim})

    return left.groupBy("l", "x", "y").cogroup(right.groupBy("m", "s", "t")).applyInPandas(multiply, f"a {kind}, b {kind}, similarity double")
