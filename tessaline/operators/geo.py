"""Points within a distance of other points, and the region that contains a point.

`within_radius`: positions become three-dimensional unit vectors, so a great-circle radius is a chord length and neither
poles nor the date line are special. A k-d tree over a bounded sample of the points gives the cells; every point is
in one cell, and a centre is copied to each cell that its ball touches (the halo). Each cell is queried with a local
k-d tree by chord radius, and what it finds is verified with the haversine distance. Cells are only a
partitioning: the sample moves their borders, never the result.

A cell that holds more points or centres than a task should is salted on that side and the other side is copied, so
a third of all points in one spot, or a third of all requests for it, is spread over many tasks.

`in_regions`: a plane sweep over the edges of polygons, sorted by latitude, with an active edge list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Points in a cell and centres in a cell that one task takes.
CELL_POINTS, CELL_CENTRES = 8_192, 4_096
#: Most cells, and most sampled points for each cell, that the driver handles: 4,096 * 64 positions of 24 bytes.
MAX_CELLS, SAMPLE_PER_CELL = 4_096, 64


def usable(lat: Column, lon: Column) -> Column:
    """Present, finite and in range; false otherwise, never null."""
    ok = lambda v, m: ~F.isnan(v) & v.between(-m, m)
    return F.coalesce(ok(lat, 90.0) & ok(lon, 180.0), F.lit(False))


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_M):
    """Metres along the great circle, of numpy arrays in degrees."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, o = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)], axis=1)


def chord(metres: np.ndarray, radius: float = EARTH_RADIUS_M) -> np.ndarray:
    """Chord of a great-circle distance on the unit sphere, a little widened; the exact distance decides later."""
    return 2 * np.sin(np.minimum(metres / radius, np.pi) / 2) * (1 + 1e-9) + 1e-9


class Splits:
    """The k-d splits: box borders of each cell, and the walk that finds the cell of a point."""

    def __init__(self, sample: np.ndarray, cells: int):
        boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, border, left, right; axis -1: a cell, in left

        def build(points: np.ndarray, low: np.ndarray, high: np.ndarray, want: int) -> int:
            me = len(self.nodes)
            self.nodes.append((-1, 0.0, 0, 0))
            spread = points.max(0) - points.min(0) if len(points) else np.zeros(3)
            axis = int(spread.argmax())
            border = float(np.median(points[:, axis])) if len(points) else 0.0
            left = points[:, axis] < border if len(points) else np.zeros(0, bool)
            if want < 2 or len(points) < 2 or spread[axis] <= 0 or not left.any():
                boxes.append((low, high))
                self.nodes[me] = (-1, 0.0, len(boxes) - 1, 0)
                return me
            upper, lower = high.copy(), low.copy()
            upper[axis], lower[axis] = border, border
            one = build(points[left], low, upper, want // 2)
            two = build(points[~left], lower, high, want - want // 2)
            self.nodes[me] = (axis, border, one, two)
            return me

        build(sample, np.full(3, -np.inf), np.full(3, np.inf), cells)
        self.low, self.high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            axis, border, left, right = self.nodes[node]
            if axis < 0:
                out[rows] = left
            elif len(rows):
                below = points[rows, axis] < border
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def touched(self, centres: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for each cell that a centre's ball touches."""
        rows, found = [], []
        todo = [(0, np.arange(len(centres)))]
        while todo:
            node, at = todo.pop()
            axis, border, left, right = self.nodes[node]
            if not len(at):
                continue
            if axis >= 0:
                offset = centres[at, axis] - border
                todo += [(left, at[offset - reach[at] < 0]), (right, at[offset + reach[at] >= 0])]
                continue
            gap = np.maximum(np.maximum(self.low[left] - centres[at], centres[at] - self.high[left]), 0)
            near = at[(gap**2).sum(1) <= reach[at] ** 2]
            rows.append(near)
            found.append(np.full(len(near), left, np.int32))
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, int), np.zeros(0, np.int32))


class LocalTree:
    """A balanced k-d tree over the points of one cell; leaves of at most `leaf` points, boxes on every level."""

    def __init__(self, points: np.ndarray, leaf: int = 32):
        depth = max(0, int(np.ceil(np.log2(max(1, len(points)) / leaf))))
        order = np.arange(len(points))
        groups = [order]
        for _ in range(depth):
            halves = []
            for g in groups:
                p = points[g]
                axis = int((p.max(0) - p.min(0)).argmax()) if len(g) else 0
                half = len(g) // 2
                part = np.argpartition(p[:, axis], half) if len(g) > 1 else np.arange(len(g))
                halves += [g[part[:half]], g[part[half:]]]
            groups = halves
        self.order = np.concatenate(groups)
        sizes = np.array([len(g) for g in groups])
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.points = points[self.order]
        low = np.array([points[g].min(0) if len(g) else np.full(3, np.inf) for g in groups])
        high = np.array([points[g].max(0) if len(g) else np.full(3, -np.inf) for g in groups])
        self.levels = [(low, high)]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.levels.append((low, high))
        self.levels.reverse()

    def near(self, centres: np.ndarray, reach: np.ndarray, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(centre, point) pairs within chord `reach`, in blocks of bounded size."""
        if not len(self.points) or not len(centres):
            return
        who, node = np.arange(len(centres)), np.zeros(len(centres), int)
        for k, (low, high) in enumerate(self.levels):
            if k:
                who, node = np.repeat(who, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
            gap = np.maximum(np.maximum(low[node] - centres[who], centres[who] - high[node]), 0)
            keep = np.einsum("ij,ij->i", gap, gap) <= reach[who] ** 2
            who, node = who[keep], node[keep]
        count = self.start[node + 1] - self.start[node]
        ends = np.cumsum(count)
        at = 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            n = count[at:to]
            first = np.repeat(self.start[node[at:to]] - (np.cumsum(n) - n), n)
            i, j = np.repeat(who[at:to], n), first + np.arange(int(n.sum()))
            d = centres[i] - self.points[j]
            ok = np.einsum("ij,ij->i", d, d) <= reach[i] ** 2
            yield i[ok], self.order[j[ok]]
            at = to


def within_radius(
    centres: DataFrame, points: DataFrame, centre_id: str, point_id: str, centre_type: str = "bigint", point_type: str = "string",
    cell_points: int = CELL_POINTS, cell_centres: int = CELL_CENTRES,
) -> DataFrame:
    """(centre_id, point_id) of each point within its centre's radius.

    `centres` has (centre_id, lat, lon, radius), `points` (point_id, lat, lon), all of them usable; the callers drop
    others. Either may be empty: the result then is too. Equal positions are all found. An infinite radius finds
    every point.
    """
    from tessaline.runtime import cut, parallelism

    spark = points.sparkSession
    points = cut(points.select(F.col(point_id).alias("pid"), F.col("lat").cast("double"), F.col("lon").cast("double")))
    centres = centres.select(
        F.col(centre_id).alias("cid"), F.col("lat").cast("double"), F.col("lon").cast("double"), F.col("radius").cast("double")
    )
    total = points.count()
    cells = int(min(MAX_CELLS, max(2 * parallelism(spark), -(-total // cell_points))))
    # A spot of the sample is chosen by a hash of the id, so that every run takes the same.
    sample = points.orderBy(F.xxhash64("pid"), "pid").limit(min(total, cells * SAMPLE_PER_CELL) or 1).select("lat", "lon").toPandas()
    splits = Splits(unit_vectors(sample.lat.to_numpy(), sample.lon.to_numpy()), cells)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=splits.cell_of(unit_vectors(b.lat.to_numpy(), b.lon.to_numpy())))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, cell = splits.touched(unit_vectors(b.lat.to_numpy(), b.lon.to_numpy()), chord(b.radius.to_numpy()))
            yield b.iloc[rows].assign(cell=cell)

    placed = points.mapInPandas(place, f"pid {point_type}, lat double, lon double, cell int")
    spread_out = centres.mapInPandas(spread, f"cid {centre_type}, lat double, lon double, radius double, cell int")
    # One row for each cell, at most MAX_CELLS of them: how often each side must be salted.
    counts = placed.groupBy("cell").agg(F.count("*").alias("n")).join(spread_out.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    salts = counts.select(
        F.col("cell").alias("at"), F.ceil(F.col("n") / cell_points).cast("int").alias("ps"), F.ceil(F.col("m") / cell_centres).cast("int").alias("cs")
    )
    salts = spark.createDataFrame(salts.collect(), "at int, ps int, cs int")
    salt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (
        spread_out.join(F.broadcast(salts), F.col("cell") == F.col("at"))
        .withColumn("c_salt", salt("cid", F.col("cs")))
        .withColumn("p_salt", copies(F.col("ps")))
        .drop("at", "ps", "cs")
    )
    right = (
        placed.join(F.broadcast(salts), F.col("cell") == F.col("at"))
        .withColumn("p_salt", salt("pid", F.col("ps")))
        .withColumn("c_salt", copies(F.col("cs")))
        .drop("at", "ps", "cs")
    )
    keys = ["cell", "p_salt", "c_salt"]

    def query(c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"cid": c.cid[:0], "pid": p.pid[:0]})]
        if len(c) and len(p):
            tree = LocalTree(unit_vectors(p.lat.to_numpy(), p.lon.to_numpy()))
            lat, lon, radius = c.lat.to_numpy(), c.lon.to_numpy(), c.radius.to_numpy()
            p_lat, p_lon = p.lat.to_numpy(), p.lon.to_numpy()
            for i, j in tree.near(unit_vectors(lat, lon), chord(radius)):
                ok = haversine(lat[i], lon[i], p_lat[j], p_lon[j]) <= radius[i]
                out.append(pd.DataFrame({"cid": c.cid.to_numpy()[i[ok]], "pid": p.pid.to_numpy()[j[ok]]}))
        return pd.concat(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(query, f"cid {centre_type}, pid {point_type}")
    return found.select(F.col("cid").alias(centre_id), F.col("pid").alias(point_id))


def in_regions(points: DataFrame, regions: dict[str, list[tuple[float, float]]], point_id: str) -> DataFrame:
    """(point_id, region) for each point inside a polygon given as (lat, lon) corners in order.

    A point on a border belongs to the region when the even-odd rule of a ray towards greater longitude says so. The
    polygons are a parameter of the query, so their edges travel with the task; points stay where they are and nothing
    is shuffled. Within a batch points and edges are swept by latitude: each edge is compared with the points that the sweep line
    meets between its ends, all at once.
    """
    names = list(regions)
    edges = []
    for k, name in enumerate(names):
        corners = regions[name]
        for (a, b), (c, d) in zip(corners, [*corners[1:], *corners[:1]], strict=True):
            if a != c:
                edges.append((min(a, c), max(a, c), *((b, d) if a < c else (d, b)), k))
    table = np.array(sorted(edges), float).reshape(-1, 5)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lat, lon = batch.lat.to_numpy(float), batch.lon.to_numpy(float)
            order = np.argsort(lat, kind="stable")
            order = order[np.isfinite(lat[order]) & np.isfinite(lon[order])]
            y, x = lat[order], lon[order]
            odd = np.zeros((len(names), len(order)), bool)
            # An edge is met by the points between its ends: a stretch of the sorted batch.
            first, last = np.searchsorted(y, table[:, 0]), np.searchsorted(y, table[:, 1])
            for e, i, j in zip(table, first, last, strict=True):
                if i < j:
                    odd[int(e[4]), i:j] ^= e[2] + (y[i:j] - e[0]) / (e[1] - e[0]) * (e[3] - e[2]) > x[i:j]
            where, at = np.nonzero(odd)
            yield pd.DataFrame({"pid": batch.pid.iloc[order[at]].astype(object), "region": [names[k] for k in where]})

    kind = dict(points.dtypes)[point_id]
    out = points.select(F.col(point_id).alias("pid"), F.col("lat").cast("double"), F.col("lon").cast("double")).mapInPandas(
        sweep, f"pid {kind}, region string"
    )
    return out.withColumnRenamed("pid", point_id)
