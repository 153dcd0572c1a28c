"""Items that appear together: exact pair counts as a blocked Gram matrix, and how many times more often than chance.

Items are counted first. A pair can't reach `min_pairs` records if one of its items doesn't, so rarer items are
dropped, which is exact. With `min_share` (a pair must be in at least that share of the records) the number of items that stay
is at most the mean basket size divided by the share, whatever the number of records: a vocabulary whose counted size is small goes
to the tasks, which translate their records in place; a larger one is joined by a shuffle.

Items are numbered by how many records have them, the frequent ones first, and put into blocks. Each task turns its records into a binary sparse
matrix of item blocks and adds up the transpose products of its record blocks: between the first `DENSE` blocks, where most records
have items, as products of dense matrices; elsewhere as sparse products, whose entries are (i, j) codes that are combined by
sorting. What a task holds is bounded (`HELD` entries): beyond it the combined entries are emitted and summed by the shuffle, which
carries partial counts, never pairs of records. Frequent items need no special care: they are columns, not groups.

Defined results: null, blank and repeated items don't count; a null or empty basket counts as a record without items; an
empty table gives no pairs. Only the named column matters, so clashing column names don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.runtime import cut

#: Items in a block, blocks multiplied densely, records multiplied at once, and entries that a task holds before it emits them (64 MB).
BLOCK, DENSE, RECORDS, HELD = 256, 2, 8_192, 4_000_000
#: A vocabulary up to this many items travels with the tasks (some 10 MB), a larger one is joined by a shuffle.
BROADCAST_ITEMS = 100_000

_SPACE = r"[\s\u0085   -     　]+"


def clean(items: Column) -> Column:
    """Trimmed, lower-cased, not empty, each once; an empty array for null."""
    trimmed = F.transform(items, lambda x: F.lower(F.regexp_replace(x, f"^{_SPACE}|{_SPACE}$", "")))
    return F.coalesce(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def combined(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, with the sums of their counts."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
    return codes[first], np.add.reduceat(counts[order], first)


def sparse_product(column: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Codes i << 32 | j, i < j, of the entries of X'X, each as often as records have both; columns ascend within each row."""
    size = np.bincount(row) if len(row) else np.zeros(0, int)
    # Element e of a record of n items pairs with the n - 1 - e that follow it.
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    follow = np.repeat(size, size) - 1 - place
    left = np.repeat(np.arange(len(row)), follow)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(follow) - follow, follow)
    return column[left] << 32 | column[right]


def gram(batches: Iterator[pd.DataFrame], items: str = "items", numbers: pd.Index | None = None) -> Iterator[pd.DataFrame]:
    """Partial (i, j, k), i < j, of the Gram matrix of the baskets: arrays of item numbers, or of items that `numbers` has in order."""
    head = DENSE * BLOCK
    dense = np.zeros((head, head), np.int64)
    held, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def table(codes: np.ndarray, k: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"i": codes >> 32, "j": codes & 0xFFFFFFFF, "k": k})

    for batch in batches:
        for begin in range(0, len(batch), RECORDS):
            baskets = batch[items].iloc[begin : begin + RECORDS]
            sizes = baskets.map(len).to_numpy()
            if not sizes.sum():
                continue
            row = np.repeat(np.arange(len(baskets)), sizes)
            column = np.concatenate(baskets.to_numpy())
            column = column.astype(np.int64) if numbers is None else numbers.get_indexer(column).astype(np.int64)
            known = column >= 0
            row, column = row[known], column[known]
            order = np.lexsort((column, row))
            row, column = row[order], column[order]
            frequent = column < head
            if frequent.any():
                x = np.zeros((len(baskets), head), np.float32)
                x[row[frequent], column[frequent]] = 1
                # Sums of at most `RECORDS` ones are exact in single precision.
                dense += (x.T @ x).astype(np.int64)
            # Pairs with a rarer item: all pairs of the records that have one, without those between frequent items.
            rare = np.bincount(row[~frequent], minlength=len(baskets)) > 0
            mine = rare[row]
            if mine.any():
                bounds = np.searchsorted(row, np.arange(len(baskets) + 1))
                work = np.cumsum(np.where(rare, np.diff(bounds) ** 2, 0))
                for low, high in _slices(work, 8_000_000):
                    part = mine[bounds[low] : bounds[high]]
                    codes = sparse_product(column[bounds[low] : bounds[high]][part], row[bounds[low] : bounds[high]][part] - low)
                    codes = codes[(codes & 0xFFFFFFFF) >= head]
                    codes, k = combined(codes, np.ones(len(codes), np.int64))
                    held.append(codes)
                    counts.append(k)
                    if sum(map(len, held)) > HELD:
                        codes, k = combined(np.concatenate(held), np.concatenate(counts))
                        if 2 * len(codes) > HELD:
                            yield table(codes, k)
                            codes, k = codes[:0], k[:0]
                        held, counts = [codes], [k]
    yield table(*combined(np.concatenate(held), np.concatenate(counts)))
    i, j = np.nonzero(np.triu(dense, 1))
    yield pd.DataFrame({"i": i, "j": j, "k": dense[i, j]})


def _slices(work: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of records whose work is about `most` each; `work` is cumulative. A record alone may exceed it."""
    low = 0
    while low < len(work):
        done = work[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(work, done + most, "right")))
        yield low, high
        low = high


def pair_counts(records: DataFrame, items: Column, min_pairs: int = 1, min_share: float = 0.0) -> DataFrame:
    """(item_a, item_b, a, b, k, n) for each pair, item_a < item_b, in at least `min_pairs` and `min_share` of the records."""
    baskets = cut(records.select(F.monotonically_increasing_id().alias("record"), clean(items).alias("items")))
    n = baskets.count()
    least = max(min_pairs, 1, int(np.ceil(min_share * n - 1e-9)))
    frequent = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("records")).where(F.col("records") >= least)
    numbers = number(frequent)
    size = numbers.count()
    schema = "i long, j long, k long"
    if size <= BROADCAST_ITEMS:
        index = pd.Index([r["item"] for r in numbers.orderBy("number").select("item").collect()], dtype=object)
        numbers = F.broadcast(numbers)
        products = baskets.where(F.size("items") > 1).select("items").mapInPandas(lambda rows: gram(rows, "items", index), schema)
    else:
        exploded = baskets.select("record", F.explode("items").alias("item")).join(numbers, "item")
        sparse = exploded.groupBy("record").agg(F.collect_list("number").alias("items")).where(F.size("items") > 1).select("items")
        products = sparse.mapInPandas(gram, schema)
    counted = products.groupBy("i", "j").agg(F.sum("k").alias("k")).where(F.col("k") >= least)
    name = lambda s, at, c: numbers.select(F.col("item").alias(s), F.col("number").alias(at), F.col("records").alias(c))
    pairs = counted.join(name("x", "i", "x_n"), "i").join(name("y", "j", "y_n"), "j")
    swap = F.col("x") > F.col("y")
    either = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    return pairs.select(
        either("x", "y").alias("item_a"), either("y", "x").alias("item_b"), either("x_n", "y_n").alias("a"), either("y_n", "x_n").alias("b"),
        "k", F.lit(n).cast("bigint").alias("n"),
    )


def number(items: DataFrame) -> DataFrame:
    """(item, records, number): numbers from 0 in the order of falling frequency, then item; offsets are one row per partition."""
    spark = items.sparkSession
    order = [F.col("records").desc(), F.col("item")]
    placed = cut(
        items.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    )
    sizes = placed.groupBy("p").agg(F.count("*").alias("c"), F.min("m").alias("low")).orderBy("p").collect()
    start, offsets = 0, []
    for r in sizes:
        offsets.append((r.p, start - r.low))
        start += r.c
    shift = spark.createDataFrame(offsets, "p int, shift bigint")
    return cut(placed.join(F.broadcast(shift), "p").select("item", "records", (F.col("m") + F.col("shift")).alias("number")))


def above_chance(pairs: DataFrame, lift: float = 3.0) -> DataFrame:
    """Pairs with k n >= lift a b, in whole numbers of any size."""
    wide = lambda c: F.col(c).cast("decimal(38,0)") if c != "lift" else F.lit(lift)
    if float(lift).is_integer():
        return pairs.where(wide("k") * wide("n") >= F.lit(int(lift)) * wide("a") * wide("b"))
    return pairs.where(F.col("k").cast("double") * F.col("n") >= F.lit(lift) * F.col("a") * F.col("b"))
