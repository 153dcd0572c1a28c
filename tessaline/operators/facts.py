"""From repeated statements to facts: candidates, counts of equal sentences, facts that say the same or the opposite. Variants are clustered by `clusters`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.functions import text
from tessaline.operators.graph import components
from tessaline.runtime import cut


def candidates(memories: DataFrame, least_words: int = 4, most_chars: int = 400) -> DataFrame:
    """(fact, memory_id, created_at): the sentences of memories that are statements, normalised."""
    sentences = F.split(F.regexp_replace("content", r"([.!?])\s+", "$1\n"), r"\n|\s\|\s")
    rows = memories.select("memory_id", "created_at", F.explode(sentences).alias("s")).select("memory_id", "created_at", text.collapsed(F.col("s")).alias("fact"))
    return rows.where((F.size(F.split("fact", " ")) >= least_words) & (F.length("fact") <= most_chars))


def distilled(found: DataFrame, support: int = 2) -> DataFrame:
    """(fact, support, first_seen, last_seen, confidence): statements of at least `support` memories; counts are partial before the shuffle."""
    per = found.groupBy("fact", "memory_id").agg(F.min("created_at").alias("at"))
    counted = per.groupBy("fact").agg(F.count("*").alias("support"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen")).where(F.col("support") >= support)
    return counted.withColumn("confidence", 1 - F.pow(F.lit(0.9), F.col("support").cast("double")))


def alike(stated: DataFrame, cosine: float, jaccard: float, same_polarity: bool) -> DataFrame:
    """(a, b, cosine), a < b, of facts (fact, user_id, content, names, v) of one user that share a name, have the same polarity or the opposite one, and reach
    both thresholds. Joined on (user, name): facts without a common name never meet."""
    from tessaline.functions import vectors

    words = F.array_distinct(F.filter(F.split(F.lower("content"), r"[ \t\n\r]+"), lambda w: w != ""))
    rows = stated.where("v is not null").select("fact", "user_id", "names", "v", words.alias("w"), text.is_positive(F.col("content")).alias("yes"))
    keyed = rows.select("fact", "user_id", F.explode("names").alias("n"))
    pairs = keyed.withColumnRenamed("fact", "a").join(keyed.withColumnRenamed("fact", "b"), ["user_id", "n"]).where("a < b").select("a", "b").distinct()
    side = lambda s: rows.select(F.col("fact").alias(s), F.col("v").alias(f"v_{s}"), F.col("w").alias(f"w_{s}"), F.col("yes").alias(f"yes_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cosine", vectors.cosine(F.col("v_a"), F.col("v_b")))
    sign = F.col("yes_a") == F.col("yes_b") if same_polarity else F.col("yes_a") != F.col("yes_b")
    return met.where(sign & (F.col("cosine") >= cosine) & (text.jaccard(F.col("w_a"), F.col("w_b")) >= jaccard)).select("a", "b", "cosine")


OUTCOMES = "fact string, outcome string, target string, support bigint, confidence double"


class Ledger:
    """Facts that are held, and what becomes of a new one. `links` are (other, cosine, same polarity) of the facts that it is alike with."""

    def __init__(self) -> None:
        self.held: dict[str, list] = {}  # fact -> [active, support, confidence]

    def take(self, fact: str, support: int, links: list[tuple[str, float, bool]], confidence: float = 0.5) -> tuple:
        """(fact, outcome, target, support, confidence): stored, reinforced, ignored (it repeats what was superseded), superseded (it wins over the target, also at
        equal support) or rejected (the target holds)."""

        def best(same: bool) -> str | None:
            found = [(c, o) for o, c, s in links if s == same and o in self.held]
            return min(found, key=lambda x: (-x[0], x[1]))[1] if found else None

        match = best(True)
        if match is not None:
            it = self.held[match]
            if not it[0]:
                return fact, "ignored", match, it[1], round(it[2], 6)
            it[1], it[2] = it[1] + 1, min(1.0, it[2] + 0.1 * (1 - it[2]))
            return fact, "reinforced", match, it[1], round(it[2], 6)
        against = best(False)
        self.held[fact] = [True, support, confidence]
        if against is None or not self.held[against][0]:
            return fact, "stored", None, support, confidence
        if support >= self.held[against][1]:
            self.held[against][0] = False
            return fact, "superseded", against, support, confidence
        self.held[fact][0] = False
        return fact, "rejected", against, support, confidence


def ingested(stated: DataFrame, cosine: float, jaccard: float) -> DataFrame:
    """(fact, outcome, target, support, confidence) of facts (fact, user_id, created_at, support, content, names, v) taken one after another by time, nulls first.

    Facts that are alike meet by a join; only these depend on each other, so each component of the graph of alike facts is folded by itself: sorted
    runs are streamed, a task holds the ledger of one component.
    """
    pairs = cut(alike(stated, cosine, jaccard, True).withColumn("same", F.lit(True)).unionByName(alike(stated, cosine, jaccard, False).withColumn("same", F.lit(False))))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine", "same"))
    links = both.groupBy(F.col("a").alias("fact")).agg(F.collect_list(F.struct("b", "cosine", "same")).alias("links"))
    parts = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "fact")
    rows = stated.select("fact", "created_at", "support").join(links, "fact", "left").join(parts, "fact", "left")
    placed = rows.select(F.coalesce("component", "fact").alias("component"), "created_at", "fact", "support", "links")
    placed = placed.repartition("component").sortWithinPartitions("component", F.col("created_at").asc_nulls_first(), "fact")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ledger = None, Ledger()
        for b in batches:
            out = []
            for part, fact, support, found in zip(b.component, b.fact, b.support, b.links, strict=True):
                if part != now:
                    now, ledger = part, Ledger()
                met = [] if found is None else [(x["b"], x["cosine"], x["same"]) for x in found]
                out.append(ledger.take(fact, 0 if pd.isna(support) else int(support), met))
            yield pd.DataFrame(out, columns=["fact", "outcome", "target", "support", "confidence"])

    return placed.select("component", "fact", "support", "links").mapInPandas(fold, OUTCOMES)
