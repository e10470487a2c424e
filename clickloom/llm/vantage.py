"""Approximate nearest neighbours by cosine: a vantage-point tree per shard.

Unit vectors are compared by Euclidean distance, which is a metric and falls as the cosine rises.
A node of the tree parts its vectors by their distance to a vantage point; by the triangle
inequality that distance bounds from below how near a query can come to either part. A leaf is
skipped when `factor` times its bound exceeds the query's k-th distance so far. With factor one
nothing nearer is ever skipped and the search is exact; larger factors skip more.

All vectors are indexed, each in the shard of its row's hash. Equal vectors are one point of the
tree that carries its smallest ids. What a shard returns is scored anew from the original vectors, and
ties go to the smaller id: where more points than were kept lie within rounding of a query's k-th
distance, its leaves are walked once more for all of them.

Defined cases: those of `vectors`; a zero vector takes no part; a query with fewer than k candidates
gets them all; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import vectors
from clickloom.sources.staging import Staging

LEAF = 64
FACTOR = 5.0
# Points beyond k that a search keeps; queries with more points about the k-th distance are walked again.
SPARE = 8
# Rounding of a bound, a difference of two distances of unit vectors.
SLACK = 1e-6
SHARD = 8192
# Queries walked again, and pairs scored, at a time.
TOGETHER = 64
PAIRS = 1 << 16


class Tree(NamedTuple):
    """Nodes in order, parents first. A node's vectors lie between `near` and `far` of its
    parent's vantage point; a leaf has members and no vantage point."""

    parent: np.ndarray
    near: np.ndarray
    far: np.ndarray
    vantage: np.ndarray
    members: list[np.ndarray | None]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    parent, near, far, vantage, members = [], [], [], [], []
    waiting = [(-1, 0.0, 2.0, np.arange(len(points)))]
    for above, low, high, own in waiting:  # grows while it is walked
        node = len(parent)
        parent.append(above)
        near.append(low)
        far.append(high)
        if len(own) <= leaf:
            vantage.append(-1)
            members.append(own)
            continue
        # The point farthest from the first one spreads the distances.
        start = points[own[0]]
        chosen = own[np.argmin(points[own] @ start)]
        away = _distance(points[own] @ points[chosen])
        middle = np.argsort(away, kind="stable")
        half = len(own) // 2
        vantage.append(int(chosen))
        members.append(None)
        for part in (middle[:half], middle[half:]):
            waiting.append((node, float(away[part].min()), float(away[part].max()), own[part]))
    return Tree(np.array(parent), np.array(near), np.array(far), np.array(vantage), members)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def bounds(tree: Tree, points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For every node and query: how near the query can come to the node's vectors."""
    inner = np.flatnonzero(tree.vantage >= 0)
    away = {node: row for node, row in zip(inner.tolist(), _distance(points[tree.vantage[inner]] @ queries.T), strict=True)}
    result = np.zeros((len(tree.parent), len(queries)))
    for node in range(1, len(tree.parent)):
        above = int(tree.parent[node])
        apart = away[above]
        least = np.maximum(apart - tree.far[node], tree.near[node] - apart)
        result[node] = np.maximum(result[above], least)
    return result


def search(
    points: np.ndarray, tree: Tree, queries: np.ndarray, k: int, factor: float, skip: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k nearest points of each query (-1: none) and their distances, and how many distances
    were computed. `skip`: a point that is no candidate of the query, or -1."""
    n = len(queries)
    best = np.full((n, k), -1)
    reach = np.full((n, k), np.inf)
    leaves = [node for node, members in enumerate(tree.members) if members is not None]
    least = bounds(tree, points, queries)[leaves]
    seen = np.zeros(least.shape, bool)
    computed = 0

    def visit(at: int, who: np.ndarray) -> None:
        nonlocal computed
        members = tree.members[leaves[at]]
        seen[at, who] = True
        if not len(members) or not len(who):
            return
        computed += len(members) * len(who)
        away = _distance(queries[who] @ points[members].T)
        away[members[None, :] == skip[who, None]] = np.inf
        every = np.concatenate([reach[who], away], 1)
        index = np.concatenate([best[who], np.broadcast_to(members, away.shape)], 1)
        order = np.argsort(every, 1, kind="stable")[:, :k]
        reach[who] = np.take_along_axis(every, order, 1)
        best[who] = np.where(np.isinf(reach[who]), -1, np.take_along_axis(index, order, 1))

    # Each query begins where its bound is lowest, so that the others can be pruned early.
    first = np.argmin(least, 0)
    for at in np.unique(first):
        visit(at, np.flatnonzero(first == at))
    for at in np.argsort(least.mean(1), kind="stable"):
        visit(at, np.flatnonzero(~seen[at] & (factor * (least[at] - SLACK) <= reach[:, -1])))
    return best, reach, computed


def rounding(dim: int) -> float:
    """How far the squares of two distances of unit vectors that are equal can lie apart."""
    return 8 * (dim + 4) * float(np.finfo(float).eps)


def within(
    points: np.ndarray, tree: Tree, queries: np.ndarray, reach: np.ndarray, factor: float, skip: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) pairs whose distance is at most the query's `reach`, give or take rounding."""
    far = np.sqrt(reach * reach + rounding(points.shape[1]))
    least = bounds(tree, points, queries)
    found = []
    for node, members in enumerate(tree.members):
        if members is None:
            continue
        who = np.flatnonzero(factor * (least[node] - SLACK) <= far)
        away = _distance(queries[who] @ points[members].T)
        query, place = np.nonzero((away <= far[who, None]) & (members[None, :] != skip[who, None]))
        found.append((who[query], members[place]))
    query, point = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.argsort(query, kind="stable")
    return query[order], point[order]


def _cosine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results."""
    dot = np.sum(left * right, 1)
    return dot / (np.sqrt(np.sum(left * left, 1)) * np.sqrt(np.sum(right * right, 1)))


class Shard:
    """The vectors of a shard as points of a tree, and the rows that share each point."""

    def __init__(self, table: pa.Table, dim: int, leaf: int):
        vecs, ids, numbers = vectors.matrix(table, dim), vectors.ids(table), vectors.row_numbers(table)
        order = np.lexsort((numbers, ids))
        vecs, ids, numbers = vecs[order], ids[order], numbers[order]
        # Equal vectors become one point; its rows follow one another, smallest id first.
        _, point = np.unique(vecs, axis=0, return_inverse=True)
        point = point.ravel()
        grouped = np.argsort(point, kind="stable")
        self.starts = np.searchsorted(point[grouped], np.arange(point.max() + 2))
        self.original = vecs[grouped[self.starts[:-1]]]
        self.ids, self.numbers = ids[grouped], numbers[grouped]
        self.unit = _unit(self.original)
        self.tree = build(self.unit, leaf)
        self.point_of = dict(zip(self.numbers.tolist(), point[grouped].tolist(), strict=True))

    def alone(self, numbers: np.ndarray) -> np.ndarray:
        """For each row the point that stands for nothing else, or -1."""
        points = np.array([self.point_of.get(number, -1) for number in numbers.tolist()], np.int64)
        return np.where((points >= 0) & (np.diff(self.starts)[points] == 1), points, -1)

    def expanded(self, query: np.ndarray, point: np.ndarray, score: np.ndarray, own: np.ndarray, k: int):
        """query, id and score of the k best rows of each query; `query` ascends. Each point gives its k
        smallest ids, and one more in case the query's own row is among them."""
        parts = []
        for extra in range(k + 1):
            at = self.starts[point] + extra
            there = np.flatnonzero(at < self.starts[point + 1])
            there = there[self.numbers[at[there]] != own[query[there]]]
            parts.append((query[there], self.ids[at[there]], score[there]))
        query, ids, score = (np.concatenate(part) for part in zip(*parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query, "left") < k
        return query[keep], ids[keep], score[keep]


def _unit(vecs: np.ndarray) -> np.ndarray:
    # Divided by the largest component first, so that squares neither overflow nor vanish.
    scaled = vecs / np.abs(vecs).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _scored(asked: np.ndarray, original: np.ndarray, query: np.ndarray, point: np.ndarray) -> np.ndarray:
    slices = [slice(low, low + PAIRS) for low in range(0, len(query), PAIRS)]
    return np.concatenate([np.empty(0), *[_cosine(asked[query[s]], original[point[s]]) for s in slices]])


def shard_search(k: int, factor: float, leaf: int):
    kinds = {"query_row": np.int64, "query_id": np.int64, "vec_id": np.int64, "score": np.float64}

    def work(table: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if table.num_rows and queries.num_rows:
            dim = queries.column("dim")[0].as_py()
            shard = Shard(table, dim, leaf)
            asked, numbers = vectors.matrix(queries, dim), vectors.row_numbers(queries)
            units, skip = _unit(asked), shard.alone(numbers)
            best, reach, _ = search(shard.unit, shard.tree, units, k + SPARE, factor, skip)
            last, kth = reach[:, -1], reach[:, k - 1]
            crowded = np.isfinite(last) & (last * last <= np.square(np.where(np.isfinite(last), kth, 0)) + rounding(dim))

            query, place = np.nonzero((best >= 0) & ~crowded[:, None])
            found.append((query, best[query, place]))
            again = np.flatnonzero(crowded)
            for low in range(0, len(again), TOGETHER):
                who = again[low : low + TOGETHER]
                query, point = within(shard.unit, shard.tree, units[who], kth[who], factor, skip[who])
                found.append((who[query], point))
            found = [
                shard.expanded(query, point, _scored(asked, shard.original, query, point), numbers, k)
                for query, point in found
            ]
            found = [(numbers[query], vectors.ids(queries)[query], ids, score) for query, ids, score in found]
        columns = zip(*found, strict=True) if found else [[]] * len(kinds)
        return pa.table(
            {
                name: pa.array(np.concatenate([np.empty(0, kind), *column]).astype(kind))
                for (name, kind), column in zip(kinds.items(), columns, strict=True)
            }
        )

    return work


def nearest(
    embeddings: DataFrame,
    is_query: Column,
    staging: Staging,
    k: int = 5,
    factor: float = FACTOR,
    leaf: int = LEAF,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    shard: int = SHARD,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `is_query` its k nearest found."""
    rows = vectors.usable(embeddings, id_column, vector_column)
    rows = staging.put(rows.filter(F.exists("v", lambda x: x != 0)), "vectors")
    queries = rows.filter(is_query)
    n_rows, n_queries = rows.count(), queries.count()
    found = vectors.tiles(
        rows, queries, n_rows, n_queries, shard_search(k, factor, leaf),
        "query_row long, query_id long, vec_id long, score double", tile=shard,
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
