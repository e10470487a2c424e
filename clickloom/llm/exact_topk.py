"""Exact top-k by integer inner product, by selection from histograms.

All scores are computed, tile by tile, and none are kept: a pass counts them in equal bins of each
query's current range. The bin in which the k-th largest score lies becomes the next range, until
it is a single value. A last pass then keeps what lies above that value and as many ties as are
lacking, by smaller id.

A tile reports its bins from the top until it has counted as many as are wanted; the k-th largest
of all cannot lie lower than the k-th largest of a part, so nothing is lost and a tile sends at
most k bins per query. The same holds for ties.

Defined cases: those of `vectors`; a query with fewer than k candidates gets them all; an empty
table gives an empty result. Scores beyond 2**62 are refused, as they may not fit a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import vectors
from clickloom.sources.staging import Staging

BINS = 2048
# Queries of a block that are scored at a time.
TOGETHER = 256
SCALE = 1024
EXACT_DOUBLE = 2.0**53
LARGEST = 2.0**62
RESULT = "query_row long, query_id long, vec_id long, score long"


def _scores(table: pa.Table, queries: pa.Table, exact: bool):
    """Rows of queries and their scores; the query's own row is marked as no candidate."""
    dim = queries.column("dim")[0].as_py()
    kind = np.float64 if exact else np.int64
    left = np.ascontiguousarray(vectors.matrix(table, dim).astype(kind).T)
    right = vectors.matrix(queries, dim).astype(kind)
    candidate, query = vectors.row_numbers(table), vectors.row_numbers(queries)
    for low in range(0, len(query), TOGETHER):
        rows = slice(low, low + TOGETHER)
        yield rows, (right[rows] @ left).astype(np.int64), query[rows, None] != candidate[None, :]


def _number(queries: pa.Table, name: str) -> np.ndarray:
    return queries.column(name).to_numpy()


def counting(exact: bool):
    def work(table: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], []]
        if table.num_rows and queries.num_rows:
            lo, hi, need = (_number(queries, name) for name in ("lo", "hi", "need"))
            width = _number(queries, "width")
            for rows, scores, other in _scores(table, queries, exact):
                bins = (scores - lo[rows, None]) // width[rows, None]
                inside = other & (scores >= lo[rows, None]) & (scores <= hi[rows, None])
                n = len(scores)
                at = (np.arange(n)[:, None] * BINS + bins)[inside]
                counts = np.bincount(at, minlength=n * BINS).reshape(n, BINS)
                above = np.cumsum(counts[:, ::-1], 1)[:, ::-1] - counts
                query, kept = np.nonzero((counts > 0) & (above < need[rows, None]))
                found[0].append(vectors.row_numbers(queries)[rows][query])
                found[1].append(kept)
                found[2].append(counts[query, kept])
        return _table(found, ("query_row", "bin", "n"))

    return work


def selecting(exact: bool):
    def work(table: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        if table.num_rows and queries.num_rows:
            lo, need = _number(queries, "lo"), _number(queries, "need")
            candidate = vectors.ids(table)
            for rows, scores, other in _scores(table, queries, exact):
                query, at = np.nonzero(other & (scores >= lo[rows, None]))
                score = scores[query, at]
                order = np.lexsort((candidate[at], -score, query))
                query, at, score = query[order], at[order], score[order]
                tie = score == lo[rows][query]
                # Ties follow the larger scores of their query, by id.
                first = np.searchsorted(query, np.arange(len(scores)), "left")
                larger = np.bincount(query[~tie], minlength=len(scores))
                place = np.arange(len(query)) - first[query] - larger[query]
                keep = ~tie | (place < need[rows][query])
                found[0].append(vectors.row_numbers(queries)[rows][query[keep]])
                found[1].append(vectors.ids(queries)[rows][query[keep]])
                found[2].append(candidate[at[keep]])
                found[3].append(score[keep])
        return _table(found, ("query_row", "query_id", "vec_id", "score"))

    return work


def _table(columns: list[list[np.ndarray]], names: tuple[str, ...]) -> pa.Table:
    joined = [np.concatenate(parts) if parts else np.empty(0) for parts in columns]
    return pa.table({name: pa.array(part.astype(np.int64)) for name, part in zip(names, joined, strict=True)})


def _with_width(state: DataFrame) -> DataFrame:
    span = F.col("hi") - F.col("lo") + 1
    return state.withColumn("width", F.ceil(span / BINS).cast("long"))


def top_k(
    embeddings: DataFrame,
    is_query: Column,
    staging: Staging,
    k: int = 10,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of `is_query` the k best others."""
    rows = vectors.usable(embeddings, id_column, vector_column)
    # floor() of a double is a long.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = staging.put(rows.withColumn("norm", norm), "vectors")
    queries = rows.filter(is_query)
    n_queries = queries.count()
    by_dim = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("largest"))
    n_rows, largest = rows.agg(F.count("*"), F.max("norm")).first()
    bound = (largest or 0.0) ** 2 * (1 + 1e-9) + 1
    if bound >= LARGEST:
        raise ValueError(f"scores up to {bound:.3g} may not fit a long")
    exact = bound < EXACT_DOUBLE
    reach = F.ceil(F.col("norm") * F.col("largest") * (1 + 1e-9) + 1).cast("long")
    state = queries.join(by_dim, "dim").select(
        "row",
        (-reach).alias("lo"),
        reach.alias("hi"),
        F.least(F.lit(k).cast("long"), F.col("n") - 1).alias("need"),
    )
    state = staging.put(state.filter("need > 0"), "state")
    span = 2 * math.ceil(bound) + 1
    while span > 1:
        ranged = queries.join(_with_width(state), "row")
        bins = vectors.tiles(rows, ranged, n_rows, n_queries, counting(exact), "query_row long, bin long, n long")
        state = staging.put(_narrowed(state, bins), "state")
        span = state.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 1
    found = vectors.tiles(rows, queries.join(state, "row"), n_rows, n_queries, selecting(exact), RESULT)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _narrowed(state: DataFrame, bins: DataFrame) -> DataFrame:
    """The bin that holds the wanted value becomes the range, the counts above it are taken off."""
    totals = bins.groupBy("query_row", "bin").agg(F.sum("n").alias("n"))
    downwards = Window.partitionBy("query_row").orderBy(F.desc("bin"))
    totals = totals.withColumn("reached", F.sum("n").over(downwards))
    joined = _with_width(state).join(totals, F.col("row") == F.col("query_row"))
    chosen = joined.filter("reached >= need AND reached - n < need")
    return chosen.select(
        "row",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
        F.least(F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1, "hi").alias("hi"),
        (F.col("need") - (F.col("reached") - F.col("n"))).alias("need"),
    )
