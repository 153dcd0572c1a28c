"""Pairs of two tables whose word sets overlap: joined on the rarest words only, then verified.

For a bound t on 2 |a n b| / (|a| + |b|), sets of n and m words must share at least t (n + m) / 2 words, so n / m lies in [t / (2 - t), (2 - t) / t] and, with
words in one order of rising frequency, a pair shares one of the first n - ceil(t n / (2 - t)) + 1 words of either side. Only these prefixes are joined.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessaline.operators.graph import components
from tessaline.operators.retrieval import SENT_ENTRIES, broadcast_if_small, where_they_lie
from tessaline.runtime import cut, nothing

#: Sets on the left that meet all others in blocks; more of them are joined on their rarest words. Sets of a block of the right and of the left; the left is not
#: dealt to blocks but travels to where the right lies while its sets have no more words than that.
MET_WHOLE, BLOCK_RIGHT, BLOCK_LEFT, SENT_WORDS = 65_536, 16_384, 8_192, SENT_ENTRIES


class Sets:
    """Sets of words, each written with a space between them, as postings: how many words another set shares with each of them is a sum over its words."""

    def __init__(self, words: list[str], sizes: np.ndarray):
        self.sizes, tokens = sizes.astype(np.int64), " ".join(words).split(" ")
        self.code: dict[str, int] = {}
        at = np.fromiter((self.code.setdefault(t, len(self.code)) for t in tokens), np.int64, len(tokens))
        order = np.argsort(at, kind="stable")
        self.rows = np.repeat(np.arange(len(words)), self.sizes)[order]
        self.begin = np.searchsorted(at[order], np.arange(len(self.code) + 1))

    def shared(self, asked: list[str]) -> np.ndarray:
        codes = [c for c in map(self.code.get, asked, repeat(-1)) if c >= 0]
        rows = [self.rows[self.begin[c] : self.begin[c + 1]] for c in codes]
        return np.bincount(np.concatenate(rows), minlength=len(self.sizes)) if rows else np.zeros(len(self.sizes), np.int64)

    def jaccard(self, words: str, least: float) -> np.ndarray:
        """Places of the sets with a Jaccard similarity of `least` and more, above 0, to this one."""
        n = self.shared(asked := words.split(" "))
        return np.flatnonzero((n > 0) & (n / (self.sizes + len(asked) - n) >= least))

    def dice(self, words: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sets with a Dice similarity of `least` and more, above 0, to this one, and the similarities."""
        n = self.shared(asked := words.split(" "))
        score = 2.0 * n / (self.sizes + len(asked))
        at = np.flatnonzero((n > 0) & (score >= least))
        return at, score[at]


def prefix_size(n: Column, least: float) -> Column:
    return n - F.ceil(least * n - 1e-9) + 1


def _ranked(sets: DataFrame, key: str, words: str, frequency: DataFrame) -> DataFrame:
    """(key, _n, _w, _rank): the words of each set in the order of rising frequency."""
    rows = sets.select(key, F.size(words).alias("_n"), F.explode(words).alias("_w")).join(frequency, "_w")
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy("_f", "_w")))


def dice_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float) -> DataFrame:
    """(left_key, right_key, score) with 2 |a n b| / (|a| + |b|) >= least; `left` has (key, a), `right` (key, b), distinct words. Keys are unique."""
    left = cut(left.where(F.size("a") > 0).select(F.col(left_key).alias("_left"), "a"))
    right = right.where(F.size("b") > 0).select(F.col(right_key).alias("_right"), "b")
    if (many := left.count()) <= MET_WHOLE:
        return _dice_in_blocks(left, right, many, left_key, right_key, least)
    right = cut(right)
    frequency = cut(right.select(F.explode("b").alias("_w")).unionByName(left.select(F.explode("a").alias("_w"))).groupBy("_w").agg(F.count("*").alias("_f")))
    share = least / (2 - least)
    head = lambda rows: rows.where(F.col("_rank") <= prefix_size(F.col("_n"), share))
    a = head(_ranked(left, "_left", "a", frequency)).select("_left", F.col("_n").alias("_a"), "_w")
    b = head(_ranked(right, "_right", "b", frequency)).select("_right", F.col("_n").alias("_b"), "_w")
    near = a.join(b, "_w").where((F.col("_b") >= share * F.col("_a") - 1e-9) & (F.col("_a") >= share * F.col("_b") - 1e-9)).select("_left", "_right").distinct()
    both = near.join(left, "_left").join(right, "_right")
    score = 2.0 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))
    return both.select(F.col("_left").alias(left_key), F.col("_right").alias(right_key), score.alias("score")).where(F.col("score") >= least)


def _dice_in_blocks(left: DataFrame, right: DataFrame, many: int, left_key: str, right_key: str, least: float, counted: bool = False) -> DataFrame:
    """A task counts the words that each set of the left, or of a block of it, shares with each of a block of the right; only pairs found leave it, or `counted`: (left_key, n) how many there are."""
    kind = dict(right.dtypes)["_right"]
    # As one text: an array of words takes several times as much room.
    right = right.select("_right", F.array_join("b", " ").alias("words"), F.size("b").alias("size"))
    left = left.select("_left", F.array_join("a", " ").alias("words"))
    columns = [left_key, "n"] if counted else [left_key, right_key, "score"]

    def score(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return nothing(*columns)
        sets = Sets(x.words.tolist(), x["size"].to_numpy())
        if counted:
            n = np.array([len(sets.dice(words, least)[0]) for words in y.words])
            return pd.DataFrame({left_key: y["_left"].to_numpy()[n > 0], "n": n[n > 0]}) if n.any() else nothing(*columns)
        found = [sets.dice(words, least) for words in y.words]
        if not any(len(at) for at, _ in found):
            return nothing(*columns)
        at, of = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({left_key: np.repeat(y["_left"].to_numpy(), [len(a) for a, _ in found]), right_key: x["_right"].to_numpy()[at], "score": of})

    rest = "n long" if counted else f"{right_key} {kind}, score double"
    schema = f"{left_key} {dict(left.dtypes)['_left']}, {rest}"
    if left.agg(F.coalesce(F.sum(F.size(F.split("words", " "))), F.lit(0))).first()[0] <= SENT_WORDS:
        return right.mapInPandas(where_they_lie(score, left.toPandas(), BLOCK_RIGHT), schema)
    right = cut(right)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    chunks, parts = max(1, -(-right.count() // BLOCK_RIGHT)), max(1, -(-many // BLOCK_LEFT))
    x = right.select("_right", "words", "size", F.pmod(F.xxhash64("_right"), F.lit(chunks)).cast("int").alias("chunk")).select("*", every(parts).alias("part"))
    y = left.select("_left", "words", F.pmod(F.xxhash64("_left"), F.lit(parts)).cast("int").alias("part")).select("*", every(chunks).alias("chunk"))
    return x.groupBy("chunk", "part").cogroup(y.groupBy("chunk", "part")).applyInPandas(score, schema)


def dice_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float) -> DataFrame:
    """(left_key, n): how many pairs `dice_pairs` has of each key of the left that has any, without a row for each."""
    kept = cut(left.where(F.size("a") > 0).select(F.col(left_key).alias("_left"), "a"))
    if (many := kept.count()) > MET_WHOLE:
        return dice_pairs(left, right, left_key, right_key, least).groupBy(left_key).agg(F.count("*").alias("n"))
    right = right.where(F.size("b") > 0).select(F.col(right_key).alias("_right"), "b")
    return _dice_in_blocks(kept, right, many, left_key, right_key, least, counted=True).groupBy(left_key).agg(F.sum("n").alias("n"))


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, score), a < b, of keys whose sets (key, items) have a Jaccard similarity of `least` and more; joined on the rarest items only."""
    sets = cut(sets.where(F.size("items") > 0))
    frequency = cut(sets.select(F.explode("items").alias("_w")).groupBy("_w").agg(F.count("*").alias("_f")))
    head = cut(_ranked(sets, "key", "items", frequency).where(F.col("_rank") <= prefix_size(F.col("_n"), least)).select("key", "_n", "_w"))
    other = head.select(F.col("key").alias("b"), F.col("_n").alias("_b"), "_w")
    near = head.join(other, "_w").where((F.col("key") < F.col("b")) & (F.col("_b") >= least * F.col("_n") - 1e-9) & (F.col("_n") >= least * F.col("_b") - 1e-9))
    near = near.select(F.col("key").alias("a"), "b").distinct()
    both = near.join(sets.select(F.col("key").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("y")), "b")
    score = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return both.select("a", "b", score.alias("score")).where(F.col("score") >= least)


#: Keys of a group that meet each other in one place.
GROUP_BLOCK = 1_024


def jaccard_in_groups(rows: DataFrame, key: str, group: str, items: str, least: float, counted: DataFrame | None = None) -> DataFrame:
    """(a, b, score), a < b, of the rows (key, group, items: distinct words) of one group with a Jaccard similarity of `least` and more, above 0; one for each two rows.

    Rows meet whole, not word by word: what is shuffled is each row once for either side. Groups of more than `GROUP_BLOCK` rows are dealt to blocks,
    and each two blocks meet by themselves. `counted` has the group of each row, or of more, where that is cheaper to count.
    """
    counted = (rows if counted is None else counted).select(F.col(group).alias("large"))
    rows = rows.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(items).alias("t")).where("k is not null and g is not null and size(t) > 0")
    blocks = F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks")
    large = broadcast_if_small(counted.groupBy("large").agg(blocks).where("blocks > 1"), 200_000)
    placed = rows.join(large, F.col("g") == F.col("large"), "left").select("k", "g", "t", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    left = placed.select("g", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), F.col("k").alias("a"), F.col("t").alias("s"))
    right = placed.select("g", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"), F.col("block").alias("y"), F.col("k").alias("b"), "t")
    # Two blocks meet once, in either order of their keys; inside a block each two rows are met twice.
    once = F.when(F.col("x") == F.col("y"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    near = (F.size("s") >= least * F.size("t") - 1e-9) & (F.size("t") >= least * F.size("s") - 1e-9)
    both = left.join(right, ["g", "x", "y"]).where(once & near).withColumn("n", F.size(F.array_intersect("s", "t")))
    score = F.col("n") / (F.size("s") + F.size("t") - F.col("n"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score")).where(F.col("score") >= least)


def threads(items: DataFrame, least: float, noise: float) -> DataFrame:
    """(key, thread) of keys (key, item) linked by Jaccard pairs, in groups of two and more; items that more than a share `noise` of the keys have are left out."""
    keys = items.agg(F.countDistinct("key").alias("keys"))
    common = items.groupBy("item").agg(F.count("*").alias("f")).crossJoin(F.broadcast(keys)).where(F.col("f") <= noise * F.col("keys")).select("item")
    sets = items.join(common, "item", "left_semi").groupBy("key").agg(F.collect_list("item").alias("items"))
    pairs = cut(jaccard_pairs(sets, least))
    return components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("key"), F.col("component").alias("thread"))
