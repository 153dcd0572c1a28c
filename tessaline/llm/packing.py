"""Filling containers of a fixed capacity: sum-of-squares packing.

Items are put one after another where the sum over all residual gaps g of N(g)^2, with N(g) open containers that have g
left, becomes smallest. An item above the capacity, and only such an item, is divided: into pieces that fill a container each, and a
rest that is packed like any other item.

Packing is a sequential rule, so pieces are first dealt, by a hash of their id and number, to groups of about `GROUP` pieces; each group is packed
in one task, larger pieces first, and container numbers are (group, number in group). Pieces that fill a container alone are numbered without
being packed. A group leaves a handful of containers open, so its size bounds the loss: with some ten thousand pieces in a group it is under
a percent. Groups are equally large whatever the ids and sizes, so no source, key or long text can make one hot; each has a partition of
its own, as the work is in the packing, not in the bytes.

Defined results: an item of size 0 or null needs no room and is in no container (container null, piece 0 of 0 tokens); an empty table
gives no rows; ties go to the smallest gap, then to the container opened last. Sizes count whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.runtime import parallelism

GROUP = 16_384


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, all of 1..capacity, in the order given."""
    counts = np.zeros(capacity + 1, np.int64)
    never = np.iinfo(np.int64).max
    holding: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for k, s in enumerate(sizes.tolist()):
        best, gap = (2 * int(counts[capacity - s]) + 1 if s < capacity else 0), capacity
        if s < capacity:
            # Change of the sum for each gap that has room; one that the item closes leaves the sum.
            change = 2 * (counts[: capacity - s] - counts[s:capacity] + 1)
            change[0] = 1 - 2 * counts[s]
            change[counts[s:capacity] == 0] = never
            at = int(change.argmin())
            if change[at] <= best and change[at] != never:
                gap = s + at
        if gap == capacity:
            place, opened = opened, opened + 1
        else:
            place = holding[gap].pop()
            counts[gap] -= 1
        if gap > s:
            counts[gap - s] += 1
            holding.setdefault(gap - s, []).append(place)
        out[k] = place
    return out


def divided(items: DataFrame, size: str, capacity: str) -> DataFrame:
    """One row for each piece: piece_no, first_token, piece_tokens. Items within the capacity are one piece."""
    n, c = F.coalesce(F.col(size), F.lit(0)), F.col(capacity)
    pieces = F.greatest(F.ceil(n / c).cast("int"), F.lit(1))
    cut_up = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0), pieces - 1)))
    first = F.col("piece_no") * c
    return cut_up.withColumn("first_token", first.cast("int")).withColumn("piece_tokens", F.least(c, n - first).cast("int"))


def pack(items: DataFrame, id_col: str, size: str, budgets: list[tuple[str, int]], group: int = GROUP) -> DataFrame:
    """(budget_name, id, piece_no, first_token, piece_tokens, container) for each budget (name, capacity).

    The budgets are a parameter of a few rows; every item meets each of them.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[id_col]
    wanted = F.array(*(F.struct(F.lit(name).alias("budget_name"), F.lit(int(c)).alias("capacity")) for name, c in budgets))
    sized = items.select(F.col(id_col).alias("id"), F.col(size).alias("n"))
    pieces = divided(sized.select("id", "n", F.explode(wanted).alias("b")).select("id", "n", "b.*"), "n", "capacity").drop("n")
    # Pieces, not items, make a group: a long text or a small capacity gives many.
    total = {r.budget_name: r.pieces for r in pieces.groupBy("budget_name").agg(F.count("*").alias("pieces")).collect()}
    groups = {name: max(1, round(total.get(name, 0) / group)) for name, _ in budgets}
    count = F.element_at(F.create_map(*(F.lit(x) for g in groups.items() for x in g)), F.col("budget_name"))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece_no"), count).cast("int"))
    apart = min(sum(groups.values()), max(4 * parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(2 * apart, "budget_name", "group")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece_tokens", "id", "piece_no"], ascending=[False, True, True], kind="stable")
        size, capacity = pdf.piece_tokens.to_numpy(), int(pdf.capacity.iloc[0])
        full = int((size >= capacity).sum())
        room = (size > 0) & (size < capacity)
        names = np.full(len(pdf), None, object)
        names[size >= capacity] = [f"{pdf.group.iloc[0]}-{p}" for p in range(full)]
        names[room] = [f"{pdf.group.iloc[0]}-{full + p}" for p in sum_of_squares(size[room], capacity)]
        return pdf.assign(container=names)[["budget_name", "id", "piece_no", "first_token", "piece_tokens", "container"]]

    schema = f"budget_name string, id {kind}, piece_no int, first_token int, piece_tokens int, container string"
    return dealt.groupBy("budget_name", "group").applyInPandas(fill, schema).withColumnRenamed("id", id_col)
