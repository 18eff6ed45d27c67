"""Exact top-k by inner product: dual-tree search over cover trees.

The upper levels of a cover tree over a bounded sample divide all vectors into groups with a center and a covering radius.
The sample also gives each query a floor under its kth score, so a query is sent only to the groups whose radius allows
that score. Groups are cut into blocks; a task indexes both sides of a pair of blocks as cover trees, and a pair of nodes is
left out when the largest inner product their covering radii allow is below the worst kth score of the query node's
group. Blocks give their best k + 1, which are merged per query with a rank limit before and after the shuffle. Equal vectors are one point: only the k + 1 smallest
ids of a vector can ever be in a result (one may be the query's own), so a vector that very many rows share costs no more
than another.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonegauge.llm.common import map_columns, ship
from tonegauge.session import settle

#: Points below which a node is not divided further.
LEAF = 32


@dataclasses.dataclass
class CoverNode:
    """center, covering radius, norm of the center; children at half the scale, and as own points those children that
    hold a single vector (radius 0, so each has a bound of its own)."""

    center: np.ndarray
    radius: float
    norm: float
    points: np.ndarray
    children: list[CoverNode]

    def all_points(self) -> Iterator[np.ndarray]:
        yield self.points
        for child in self.children:
            yield from child.all_points()


def cover_tree(x: np.ndarray, points: np.ndarray | None = None, center: np.ndarray | None = None) -> CoverNode:
    """Children's centers lie more than half the radius apart, and each point within half of its center; a child
    of one point is kept as that point."""
    points = np.arange(len(x)) if points is None else points
    center = x[points].mean(axis=0).round() if center is None else center
    apart = np.sqrt(((x[points] - center) ** 2).sum(axis=1))
    radius, norm = float(apart.max(initial=0.0)), float(np.sqrt((center**2).sum()))
    if len(points) <= LEAF or radius == 0.0:
        return CoverNode(center, radius, norm, points, [])
    left, children, single = points, [], []
    squares = (x[points] ** 2).sum(axis=1)
    while len(left):
        lead = x[left[0]]
        near = squares + (lead**2).sum() - 2 * (x[left] @ lead) <= radius * radius / 4
        near[0] = True
        members = left[near]
        if len(members) > 1:
            children.append(cover_tree(x, members, lead))
        else:
            single.append(members[0])
        left, squares = left[~near], squares[~near]
    return CoverNode(center, radius, norm, np.array(single, int), children)


class DualSearch:
    """Best ``k`` (score, id) of each query over one block; ties to the smaller id."""

    def __init__(self, queries: np.ndarray, data: np.ndarray, ids: list[np.ndarray], k: int, floors: np.ndarray | None = None):
        # doubles hold sums of products exactly below 2**53; wider values are multiplied as integers
        widest = lambda x: np.abs(x.astype(float)).max(axis=0, initial=0)
        reach = float((widest(queries) * widest(data)).sum())
        if reach >= 2**63:
            raise OverflowError("an inner product may not fit into 64 bits")
        self.exact = reach < 2**53
        self.q, self.x = queries.astype(float), data.astype(float)
        self.whole_q, self.whole_x = queries, data
        self.ids, self.k = ids, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in queries]
        self.worst = np.full(len(queries), -np.inf) if floors is None else np.array(floors, float)
        self.norms = np.sqrt((self.x**2).sum(axis=1))
        self.compared = 0

    def run(self) -> None:
        if len(self.q) and len(self.x):
            self._visit(cover_tree(self.q), cover_tree(self.x))

    def _bound(self, a: CoverNode, b: CoverNode) -> float:
        value = float(a.center @ b.center) + a.norm * b.radius + a.radius * b.norm + a.radius * b.radius
        return value + 1.0 + 1e-9 * (a.norm + a.radius) * (b.norm + b.radius)

    def _visit(self, queries: CoverNode, root: CoverNode) -> None:
        group = np.concatenate(list(queries.all_points()))
        stack = [(self._bound(queries, root), root)]
        if queries.children and (queries.radius > root.radius or len(group) > 4 * LEAF):
            # the query side is divided first; each part has its own, tighter worst score
            for child in queries.children:
                self._visit(child, root)
            group = queries.points
            if not len(group):
                return
        while stack:
            bound, node = stack.pop()
            if bound < self.worst[group].min():
                continue
            if len(node.points):
                # nodes of one point: their bounds at once
                best = self.x[node.points] @ queries.center + queries.radius * self.norms[node.points]
                best += 1.0 + 1e-9 * (queries.norm + queries.radius) * self.norms[node.points]
                near = node.points[best >= self.worst[group].min()]
                if len(near):
                    self._compare(group, near)
            # the most promising last, so that it is taken first
            stack.extend(sorted(((self._bound(queries, child), child) for child in node.children), key=lambda pair: pair[0]))

    def _compare(self, group: np.ndarray, points: np.ndarray) -> None:
        self.compared += len(group) * len(points)
        if self.exact:
            scores = self.q[group] @ self.x[points].T
        else:
            scores = self.whole_q[group] @ self.whole_x[points].T
        for row, query in zip(scores, group.tolist()):
            bar = self.worst[query]
            if len(row) > self.k:
                bar = max(bar, np.partition(row, len(row) - self.k)[len(row) - self.k])
            found = np.flatnonzero(row >= bar)
            if len(found):
                new = [(-int(row[i]), int(number)) for i in found for number in self.ids[points[i]]]
                self.best[query] = sorted(self.best[query] + new)[: self.k]
                if len(self.best[query]) == self.k:
                    self.worst[query] = -self.best[query][-1][0]


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int = 256) -> DataFrame:
    """vec_id, v: vectors as floor(scale * x). Rows without an id or with a NULL or non-finite component are left out."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & finite)
    return rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("v")).distinct()


@dataclasses.dataclass
class UpperTree:
    """Centers of the upper levels of a cover tree over a bounded sample, and the sample itself, by length of the vectors."""

    centers: dict[int, np.ndarray]
    sample: dict[int, tuple[np.ndarray, np.ndarray]]

    def own_center(self, length: int) -> np.ndarray:
        """Lengths the sample does not have are one group around the origin."""
        return self.centers.get(length, np.zeros((1, length)))

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest center of each vector, and the distance to it."""
        centers = self.own_center(vectors.shape[1])
        squares = (vectors**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * (vectors @ centers.T)
        group = squares.argmin(axis=1)
        return group, np.sqrt(((vectors - centers[group]) ** 2).sum(axis=1))

    def floors(self, vectors: np.ndarray, k: int) -> np.ndarray:
        """What each query's kth best score cannot be below: its kth best in the sample, whose rows are candidates too."""
        points, counts = self.sample.get(vectors.shape[1], (np.zeros((0, vectors.shape[1])), np.zeros(0, int)))
        rows = np.repeat(np.arange(len(points)), np.minimum(counts, k))
        if len(rows) < k:
            return np.full(len(vectors), -np.inf)
        scores = (vectors @ points.T)[:, rows]
        slack = 1.0 + 1e-9 * np.sqrt((vectors**2).sum(axis=1)) * float(np.sqrt((points**2).sum(axis=1)).max(initial=0.0))
        return np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k] - slack


def upper_tree(sample: list[tuple[list[int], int]], groups: int) -> UpperTree:
    """The largest nodes are divided until there are ``groups`` of them or none can be divided."""
    centers, kept = {}, {}
    for length in {len(v) for v, _ in sample}:
        own = [v for v, _ in sample if len(v) == length]
        x = np.array(own, float).reshape(len(own), length)
        frontier, whole = [cover_tree(x)], []
        while frontier and len(frontier) + len(whole) < groups:
            frontier.sort(key=lambda node: sum(map(len, node.all_points())))
            node = frontier.pop()
            frontier.extend(node.children)
            if not node.children:
                whole.append(node)
        centers[length] = np.array([node.center for node in (frontier + whole)[:groups]])
        kept[length] = (x, np.array([n for v, n in sample if len(v) == length]))
    return UpperTree(centers, kept)


def by_length(values: list[list[int]]):
    """Vectors of one length at a time, with their places."""
    lengths = np.array([len(v) for v in values])
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, np.array([values[i] for i in at], float).reshape(len(at), length)


def place_points(points: DataFrame, get_tree) -> DataFrame:
    """v, ids, d (length), g (group) and apart (distance to its center) of every distinct vector."""

    def make():
        tree = get_tree()

        def step(values, ids):
            group, apart = [0] * len(values), [0.0] * len(values)
            for _, at, x in by_length(values):
                for i, g, r in zip(at, *tree.place(x)):
                    group[i], apart[i] = int(g), float(r)
            return [values, ids, [len(v) for v in values], group, apart]

        return step

    return map_columns(points, [F.col("v"), F.col("ids")], "v array<bigint>, ids array<bigint>, d int, g int, apart double", make)


def needed_groups(probes: DataFrame, get_tree, radii: dict[tuple[int, int], float], k: int) -> DataFrame:
    """v, qkey, d, floor, and the groups whose best possible score is not below the query's floor."""

    def make():
        tree = get_tree()

        def step(values, keys):
            floors, needs = [0.0] * len(values), [[]] * len(values)
            for length, at, x in by_length(values):
                centers = tree.own_center(length)
                radius = np.array([radii.get((length, g), -1.0) for g in range(len(centers))])
                norms = np.sqrt((x**2).sum(axis=1))[:, None]
                reach = np.sqrt((centers**2).sum(axis=1)) + np.maximum(radius, 0.0)
                best = x @ centers.T + norms * radius + 1.0 + 1e-9 * norms * reach
                low = tree.floors(x, k)
                wanted = (best >= low[:, None]) & (radius >= 0)
                for row, i in enumerate(at):
                    floors[i], needs[i] = float(low[row]), np.flatnonzero(wanted[row]).tolist()
            return [values, keys, [len(v) for v in values], floors, needs]

        return step

    return map_columns(probes, [F.col("v"), F.col("qkey")], "v array<bigint>, qkey bigint, d int, low double, needs array<int>", make)


def _search(data: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(data) or not len(queries):
        return pd.DataFrame({"qkey": [], "vec_id": [], "score": []}).astype("int64")
    find = DualSearch(np.stack(queries["v"].to_numpy()), np.stack(data["v"].to_numpy()), list(data["ids"]), k, queries["low"].to_numpy())
    find.run()
    rows = [(name, number, -score) for name, best in zip(queries["qkey"].tolist(), find.best) for score, number in best]
    return pd.DataFrame(rows, columns=["qkey", "vec_id", "score"]).astype("int64")


def blocks_of(counts: dict[tuple[int, int], int], size: int) -> Column:
    """Number of blocks of the row's group (d, g): a bounded map, as there are at most ``groups`` for each length."""
    entries = [F.lit(x) for (d, g), n in sorted(counts.items()) for x in (f"{d}:{g}", max(1, -(-n // size)))]
    return F.coalesce(F.element_at(F.create_map(*entries), F.concat_ws(":", "d", "g")), F.lit(1)) if entries else F.lit(1)


def top_k(
    df: DataFrame, is_query: Column, k: int = 5, data_block: int = 4096, query_block: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding",
    groups: int = 256, sample: int = 4096,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` largest inner products with all other rows.

    ``is_query`` is a condition on the column vec_id. Fewer candidates than k: all of them. Rows that repeat an id and its vector are one
    row; a row with the query's own id is never its candidate. Only vectors of one length are compared; a scalar product that
    might leave 64 bits is an error. ``sample`` distinct vectors (those with the smallest hash) give the upper tree of at
    most ``groups`` groups; every row is placed in a group and searched.
    """
    spark = df.sparkSession
    rows = settle(whole_vectors(df, vec_id, embedding), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1)
    points = few.groupBy("v").agg(F.collect_list("vec_id").alias("ids"))
    drawn = points.orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    get_tree = ship(spark, upper_tree([(r["v"], len(r["ids"])) for r in drawn], groups))
    placed = settle(place_points(points, get_tree), "placed")
    sizes = placed.groupBy("d", "g").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()
    radii = {(r["d"], r["g"]): r["radius"] for r in sizes}
    asked = rows.where(is_query)
    probes = asked.groupBy("v").agg(F.min("vec_id").alias("qkey"))
    needed = settle(needed_groups(probes, get_tree, radii, k + 1), "probes")
    wanted = needed.select("v", "qkey", "d", "low", F.explode("needs").alias("g"))
    asked_of = {(r["d"], r["g"]): r["n"] for r in wanted.groupBy("d", "g").agg(F.count("*").alias("n")).collect()}
    counts = {(r["d"], r["g"]): r["n"] for r in sizes if (r["d"], r["g"]) in asked_of}
    parts, askers = blocks_of(counts, data_block), blocks_of(asked_of, query_block)
    number = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # data of groups that no query needs is not sent anywhere
    left = placed.join(F.broadcast(spark.createDataFrame(list(counts) or [(-1, -1)], "d int, g int")), ["d", "g"]).select("v", "ids", "d", "g", number(parts).alias("b"), every(askers).alias("q"))
    right = wanted.select("v", "qkey", "low", "d", "g", number(askers).alias("q"), every(parts).alias("b"))
    key = ["d", "g", "b", "q"]

    def search(data, queries):
        return _search(data, queries, k + 1)

    # many tasks: block pairs are small but take time, so they are not put together by size
    pairs = sum(max(1, -(-n // data_block)) * max(1, -(-asked_of[at] // query_block)) for at, n in counts.items())
    left, right = (side.repartition(max(1, min(pairs, 20_000)), *key) for side in (left, right))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "qkey bigint, vec_id bigint, score bigint")
    order = [F.desc("score"), F.asc("vec_id")]
    merged = found.withColumn("_r", F.row_number().over(Window.partitionBy("qkey").orderBy(*order))).where(F.col("_r") <= k + 1)
    members = asked.join(probes, "v").select("qkey", F.col("vec_id").alias("query_id"))
    pairs_of = members.join(merged, "qkey").where("query_id <> vec_id")
    ranked = pairs_of.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
