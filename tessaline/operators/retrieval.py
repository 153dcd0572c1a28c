"""Lexical and vector retrieval: BM25 postings, cosine top-k, and their fusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.operators.ranking import top_per_group
from tessaline.runtime import cut, nothing, parallelism

K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of ASCII, with repeats."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


#: Documents of a block, sets of terms that meet it in one task, and scores of a task held at once (32 MB).
BLOCK_DOCUMENTS, BLOCK_SETS, HELD_SCORES = 32_768, 8_192, 4_194_304
#: Terms that travel with the tasks; more of them are joined. Keys that come more than once and are told from the others by a broadcast.
SENT_TERMS, SENT_KEYS = 200_000, 200_000
#: Terms of all sets together that travel to where the documents lie; beyond that documents and sets meet in blocks.
SENT_ENTRIES = 1_000_000
#: Keys found that travel to the rows of which something else is asked.
FOUND_KEYS = 500_000


def bm25(documents: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", k: int = 10, boost=lambda term: F.lit(1.0)) -> DataFrame:
    """(query_id, key, score, rank): the k best documents of each query (query_id, query_text); `boost`, above 0, weighs a term.

    Queries of the same terms are scored once. Their sets of terms travel to the documents, which are scored where they lie: what is shuffled are hashes of the keys and k rows per
    set and task, neither texts nor a row for each document that a query meets. Only documents whose key comes again, or all where the sets are too many to travel, are dealt to blocks.
    Rows of one key are one document, as are those of one query_id; rows of one key and length count once in a term's documents. `documents` is read three times.
    """
    kind, asked_kind, spark = dict(documents.dtypes)[key], dict(queries.dtypes)["query_id"], documents.sparkSession
    each = queries.select("query_id", F.array_distinct(terms(F.col("query_text"))).alias("t")).where(F.size("t") > 0)
    asked = cut(each.groupBy("query_id").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("t"))), " ").alias("asked")))
    sets = cut(asked.select("asked").distinct().withColumn("set", F.monotonically_increasing_id()))
    entries = sets.select("set", F.posexplode(F.split("asked", " ")).alias("at", "term"))

    rows = documents.select(F.col(key).alias("_k"), terms(F.col(text)).alias("t"))
    alone, again = _by_repeats(rows, entries.count() <= SENT_ENTRIES)
    alone = None if alone is None else alone.select("_k", F.array_size("t").alias("length"), F.lit(1).cast("bigint").alias("n"), F.array_join("t", " ").alias("words"))
    if again is not None:
        joined = again.select("_k", F.array_size("t").alias("length"), F.array_join("t", " ").alias("words"))
        again = cut(joined.groupBy("_k", "length").agg(F.count("*").alias("n"), F.array_join(F.collect_list("words"), " ").alias("words")))
    merged = again if alone is None else alone if again is None else alone.unionByName(again)

    # One pass counts a term's documents and, by a term that no text has, all documents and their lengths.
    every_term = F.array_append(F.coalesce(F.array_distinct(F.when(F.col("length") > 0, F.split("words", " "))), F.array().cast("array<string>")), "")
    vocabulary = broadcast_if_small(entries.select("term").distinct().union(spark.sql("select '' as term")), SENT_TERMS)
    met = merged.select("n", "length", F.explode(every_term).alias("term")).join(vocabulary, "term", "left_semi")
    counted = cut(met.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("length")).alias("total"), F.sum(F.when(F.col("length").isNotNull(), F.col("n"))).alias("sized")))
    size = counted.where("term = ''").first()
    docs, mean = (size.docs, (size.total / size.sized if size.sized else None) or 1.0) if size else (0, 1.0)
    df = broadcast_if_small(counted.where("term <> ''").select("term", "df"), SENT_TERMS)
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = entries.join(df, "term").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("at", "term", (boost(F.col("term")) * idf).alias("w")))).alias("x"))
    weighed = cut(weighed.select("set", F.array_join("x.term", " ").alias("asked"), F.col("x.w").alias("weights")))

    columns, schema = ["set", key, "score"], f"set long, {key} {kind}, score double"

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return nothing(*columns)
        x = x.sort_values("_k", kind="stable", na_position="last")
        found = list(_best_documents(x, y, k, mean))
        if not found:
            return nothing(*columns)
        # One place for each key; keys ascend.
        first = x["_k"][~x["_k"].duplicated()].to_numpy()
        return pd.DataFrame({"set": np.concatenate([np.full(len(at), s) for s, at, _ in found]), key: first[np.concatenate([at for _, at, _ in found])], "score": np.concatenate([of for _, _, of in found])})

    parts = []
    if alone is not None:
        # Fewer tasks, each of several blocks: a task gives k rows of each set.
        tasks = max(parallelism(spark), -(-size.docs // (4 * BLOCK_DOCUMENTS)) if size else 1)
        sent = weighed.toPandas()
        sent["weights"] = [np.asarray(w, np.float64) for w in sent.weights]  # lists where the session collects without Arrow
        parts.append(alone.where("length > 0").coalesce(tasks).mapInPandas(where_they_lie(score, sent, BLOCK_DOCUMENTS), schema))
    if again is not None:
        chunks, blocks = max(1, -(-again.count() // BLOCK_DOCUMENTS)), max(1, -(-weighed.count() // BLOCK_SETS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = again.where("length > 0").select("*", F.pmod(F.xxhash64("_k"), F.lit(chunks)).cast("int").alias("chunk")).select("*", every(blocks).alias("part"))
        right = weighed.select("*", F.pmod(F.xxhash64("set"), F.lit(blocks)).cast("int").alias("part")).select("*", every(chunks).alias("chunk"))
        parts.append(left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInPandas(score, schema))
    best = top_per_group(reduce(DataFrame.unionByName, parts).withColumn("_s", F.round("score", 9)), ["set"], [F.col("_s").desc(), F.col(key).asc_nulls_last()], k)
    answered = asked.join(sets, "asked").select(F.col("query_id").cast(asked_kind).alias("query_id"), "set")
    return answered.join(best, "set").select("query_id", key, "score", "rank")


def _by_repeats(rows: DataFrame, apart: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows whose key `_k` comes once, those whose key comes again), None where there are none; all in the second unless `apart` or if too many come again."""
    if not apart:
        return None, rows
    hashed = F.xxhash64("_k").alias("_h")
    repeated = cut(rows.groupBy(hashed).count().where("count > 1").select("_h"))
    if not (many := repeated.count()):
        return rows, None
    if many > SENT_KEYS:
        return None, rows
    marked, repeated = rows.withColumn("_h", hashed), F.broadcast(repeated)
    return marked.join(repeated, "_h", "left_anti").drop("_h"), marked.join(repeated, "_h", "left_semi").drop("_h")


def where_they_lie(meet, few: pd.DataFrame, block: int):
    """For mapInPandas: what `meet` gives of each `block` rows of a task with all rows of the few."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= block:
                yield meet(pd.concat(held, ignore_index=True), few)
                held = []
        if held:
            yield meet(pd.concat(held, ignore_index=True), few)

    return run


def of_found(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows whose key was found: filtered where they lie while the keys found are few enough to travel, so that a join doesn't shuffle the others."""
    return rows.join(broadcast_if_small(found.select(key).distinct(), FOUND_KEYS), key, "left_semi")


def _best_documents(x: pd.DataFrame, y: pd.DataFrame, k: int, mean: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(set, places, scores) of each set's k best keys of a block, ties to the smaller place; `x` (_k, length, n, words) in the order of keys, `y` (set, asked, weights)."""
    asked = [t.split(" ") for t in y.asked]
    code: dict[str, int] = {}
    codes = [np.array([code.setdefault(t, len(code)) for t in a]) for a in asked]
    rows, size = len(x), len(code)
    row = np.repeat(np.arange(rows), (x.length * x.n).to_numpy(np.int64))
    at = np.fromiter(map(code.get, " ".join(x.words).split(" "), repeat(-1)), np.int64, len(row))
    entry, tf = np.unique(at[at >= 0] * rows + row[at >= 0], return_counts=True)
    if not len(entry):
        return
    term, row = entry // rows, entry % rows
    w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * x.length.to_numpy(np.float64)[row] / mean))
    # Rows of one key follow each other and are one place.
    place = np.cumsum(~x["_k"].duplicated().to_numpy()) - 1
    places = int(place[-1]) + 1
    entry = term * places + place[row]
    starts = np.flatnonzero(np.diff(entry, prepend=-1))
    w, entry = np.add.reduceat(w, starts), entry[starts]
    term, place = entry // places, entry % places
    begin = np.searchsorted(term, np.arange(size + 1))
    # Terms of many documents are rows of a dense product, the others are added where they are met.
    common = np.flatnonzero(np.diff(begin) > places / 8)
    dense = np.zeros((len(common), places))
    for i, t in enumerate(common):
        dense[i, place[begin[t] : begin[t + 1]]] = w[begin[t] : begin[t + 1]]
    column = np.full(size, -1)
    column[common] = np.arange(len(common))
    held, k = max(1, HELD_SCORES // places), min(k, places)
    for low in range(0, len(y), held):
        part = range(low, min(len(y), low + held))
        factor = np.zeros((len(part), len(common)))
        for i, j in enumerate(part):
            c = column[codes[j]]
            np.add.at(factor[i], c[c >= 0], y.weights.iloc[j][c >= 0])
        scores = factor @ dense
        for i, j in enumerate(part):
            mine = scores[i]
            for t, weight in zip(codes[j], y.weights.iloc[j], strict=True):
                if column[t] < 0:
                    mine[place[begin[t] : begin[t + 1]]] += weight * w[begin[t] : begin[t + 1]]
            # The k best as rounded are among those within a rounding of the k-th; only these are rounded.
            least = np.partition(mine, places - k)[places - k]
            best = np.flatnonzero((mine >= least - 2e-9) & (mine > 0))
            best = best[np.argsort(-np.round(mine[best], 9), kind="stable")[:k]]
            if len(best):
                yield y.set.iloc[j], best, mine[best]


#: Queries and vectors of a block of the product: some 16 MB of either at 64 dimensions, and their scores.
BLOCK_QUERIES, BLOCK_VECTORS = 1_024, 16_384


def broadcast_if_small(rows: DataFrame, most: int) -> DataFrame:
    """A table for a nested-loop join, marked for broadcast after its rows are counted; a larger one is left to the planner's own choice."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def cosine_top(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, similarity, rank) of each query vector's k best; zero vectors score 0, a query's own key is left out.

    A blocked product: both sides are dealt to blocks by a hash, each task multiplies one block of vectors with one of queries and keeps k of each
    query, so what is shuffled again is k rows per query and block. Vectors of another length than the query's take no part.
    """
    kinds = dict(vectors.dtypes)
    asked = cut(queries.select("query_id", F.col("query_vector").cast("array<double>").alias("q")).where("query_id is not null and q is not null"))
    base = cut(vectors.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("v")).where("_k is not null and v is not null"))
    many = max(1, -(-asked.count() // BLOCK_QUERIES))
    rows = max(1, -(-base.count() // BLOCK_VECTORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("_k", "v", F.pmod(F.xxhash64("_k"), F.lit(rows)).cast("int").alias("chunk")).select("*", every(many).alias("block"))
    right = asked.select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int").alias("block")).select("*", every(rows).alias("chunk"))
    schema = f"query_id {dict(asked.dtypes)['query_id']}, {key} {kinds[key]}, similarity double"

    def multiply(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", key, "similarity"]
        if x.empty or y.empty:
            return nothing(*columns)
        out = []
        for size, part in y.groupby(y.q.map(len)):
            mine = x[x.v.map(len) == size].sort_values("_k")
            if mine.empty:
                continue
            a, b = _units(np.stack(mine.v.to_numpy())), _units(np.stack(part.q.to_numpy()))
            score = b @ a.T
            score[part.query_id.to_numpy()[:, None] == mine["_k"].to_numpy()[None, :]] = -np.inf
            # Ties go to the smaller key: keys ascend, and the sort is stable.
            order = np.argsort(-np.round(score, 9), axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(part)), order.shape[1])
            found = pd.DataFrame({"query_id": part.query_id.to_numpy()[at], key: mine["_k"].to_numpy()[order.ravel()], "similarity": score[at, order.ravel()]})
            out.append(found[np.isfinite(found.similarity)])
        return pd.concat(out) if out else nothing(*columns)

    scored = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInPandas(multiply, schema)
    return top_per_group(scored.withColumn("_s", F.round("similarity", 9)), ["query_id"], [F.col("_s").desc(), F.col(key)], k).drop("_s")


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fused(lexical: DataFrame, vector: DataFrame, key: str, weights: tuple[float, float]) -> DataFrame:
    """(query_id, key, score) of two scored lists, each scaled by its best score; a missing leg counts 0."""
    def scaled(df: DataFrame, score: str, name: str) -> DataFrame:
        from pyspark.sql import Window as W

        return df.withColumn(name, F.col(score) / F.max(score).over(W.partitionBy("query_id"))).select("query_id", key, name)

    joined = scaled(lexical, "score", "x").join(scaled(vector, "similarity", "y"), ["query_id", key], "full_outer")
    total = sum(weights)
    return joined.select("query_id", key, (F.coalesce("x", F.lit(0.0)) * (weights[0] / total) + F.coalesce("y", F.lit(0.0)) * (weights[1] / total)).alias("score"))
