"""What holds a graph together: articulation points, bridges, curvature, gates. Edges are (src, dst); loops and parallels are removed.

Components are found in the cluster; each is then searched by depth in one task. The search is linear in a component's edges and holds
them as numbers, some forty bytes an edge; a component above `LARGEST` edges is an error, as no task should hold it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.operators.graph import components
from tessaline.runtime import cut

LARGEST = 20_000_000


def simple(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def search(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[dict[int, int], list[tuple[int, int]], dict[int, int]]:
    """(node -> pieces it leaves beyond one, bridges, node -> nodes below its cut subtrees) of a connected graph, by one depth-first search without recursion."""
    order = np.argsort(np.concatenate([src, dst]), kind="stable")
    ends = np.concatenate([dst, src])[order]
    begin = np.searchsorted(np.concatenate([src, dst])[order], np.arange(n + 1))
    number, low, size = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, np.int64)
    at = begin[:-1].copy()
    parent = np.full(n, -1)
    cuts: dict[int, int] = {}
    bridges: list[tuple[int, int]] = []
    off: dict[int, int] = {}
    clock = children = 0
    number[0] = low[0] = clock
    stack = [0]
    while stack:
        v = stack[-1]
        if at[v] < begin[v + 1]:
            w = int(ends[at[v]])
            at[v] += 1
            if number[w] < 0:
                clock += 1
                number[w] = low[w] = clock
                parent[w] = v
                stack.append(w)
            elif w != parent[v]:
                low[v] = min(low[v], number[w])
            continue
        stack.pop()
        p = int(parent[v])
        if p < 0:
            continue
        low[p] = min(low[p], low[v])
        size[p] += size[v]
        if low[v] > number[p]:
            bridges.append((p, v))
        if p == 0:
            children += 1
            if children > 1:
                cuts[0] = children - 1
                off[0] = int(n - 1 - size[v]) if children == 2 else off[0]
        elif low[v] >= number[p]:
            cuts[p] = cuts.get(p, 0) + 1
            off[p] = off.get(p, 0) + int(size[v])
    return cuts, bridges, off


def _searched(edges: DataFrame, schema: str, make) -> DataFrame:
    """`make` (names, component size, what the search gives) for each component."""
    rows = simple(edges)
    label = cut(components(rows))
    grouped = rows.join(label.withColumnRenamed("node", "src"), "src")
    grouped = cut(grouped)
    most = grouped.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if most > LARGEST:
        raise ValueError(f"a component has {most} edges, one task searches at most {LARGEST}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf.src, pdf.dst]).astype(str), return_inverse=True)
        m = len(pdf)
        return pd.DataFrame(make(names, *search(codes[:m], codes[m:], len(names))), columns=[c.split(" ")[0] for c in schema.split(", ")])

    return grouped.groupBy("component").applyInPandas(run, schema)


def articulation(edges: DataFrame) -> DataFrame:
    """(node, pieces, nodes): nodes whose loss leaves more than one piece, and the size of their component."""
    return _searched(edges, "node string, pieces int, nodes int", lambda names, cuts, bridges, off: [(names[v], k + 1, len(names)) for v, k in cuts.items()])


def bridges(edges: DataFrame) -> DataFrame:
    """(src, dst) of the edges whose loss parts a component; src < dst."""
    return _searched(edges, "src string, dst string", lambda names, cuts, found, off: [tuple(sorted((names[a], names[b]))) for a, b in found])


def protection(edges: DataFrame) -> DataFrame:
    """(node, protection): the part of the component's other nodes that losing the node may cut off, at most a half on either side."""
    def make(names, cuts, found, off):
        n = len(names)
        return [(names[v], round(min(k, n - 1 - k) / max(1, n - 1), 6)) for v, k in off.items()]

    return _searched(edges, "node string, protection double", make)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("n")).union(edges.select("dst")).groupBy("n").agg(F.count("*").alias("deg"))


def curvature(edges: DataFrame) -> DataFrame:
    """(src, dst, curvature): 4 less both degrees (Forman)."""
    deg = cut(degrees(edges))
    a, b = (deg.select(F.col("n").alias(c), F.col("deg").alias(f"{c}_deg")) for c in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (4 - F.col("src_deg") - F.col("dst_deg")).alias("curvature"))


def gated(edges: DataFrame, frequency: DataFrame, total: DataFrame, least: float = 0.2, hub: int = 200) -> DataFrame:
    """Edges without those between two names of low selectivity, 1 - ln(1 + df) / ln(1 + total), and those at hubs."""
    node = degrees(edges).join(frequency, "n").crossJoin(F.broadcast(total))
    node = cut(node.select("n", "deg", (1 - F.log(1.0 + F.col("df")) / F.log(1.0 + F.col("total"))).alias("s")))
    a, b = (node.select(F.col("n").alias(c), F.col("deg").alias(f"{c}_deg"), F.col("s").alias(f"{c}_s")) for c in ("src", "dst"))
    joined = edges.join(a, "src").join(b, "dst")
    return joined.where(~((F.col("src_s") < least) & (F.col("dst_s") < least)) & (F.greatest("src_deg", "dst_deg") <= hub)).select("src", "dst")
