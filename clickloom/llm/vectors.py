"""Vectors for searches of a query set against all rows, tile by tile.

Candidates are dealt into tiles by a hash of their row's number and queries into blocks; every tile
meets every block once, in a group of bounded size. Each candidate is sent once per block of queries,
each query once per tile.

A null id, a null vector and one with null or non-finite components take no part. Rows are told apart
by number, not by id: every row of a repeated id is a candidate, also of another row of that id, and
each such row that is a query has a result of its own. Only vectors of equal length are compared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 4096
QUERY_BLOCK = 4096


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(row, vec_id, v, dim) with components as double. Row numbers hold once the frame is written."""
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull())
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"), finite.alias("finite"))
    return rows.filter("finite").select(
        F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.size("v").alias("dim")
    )


def _part(count: int, of: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(count)).cast("int")


def tiles(
    candidates: DataFrame,
    queries: DataFrame,
    n_candidates: int,
    n_queries: int,
    work: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    tile: int = TILE,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """`work(candidates, queries)` for every tile and block; both have `row`, `vec_id`, `v`, `dim`."""
    n_tiles = max(1, -(-n_candidates // tile))
    n_blocks = max(1, -(-n_queries // block))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    every_tile = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("tile")
    left = _own(candidates).select("*", _part(n_tiles, F.col("row")).alias("tile"), every_block)
    right = _own(queries).select("*", _part(n_blocks, F.col("row")).alias("block"), every_tile)
    key = ["dim", "tile", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, schema)


def _own(frame: DataFrame) -> DataFrame:
    """Columns told apart from those of a frame of the same origin."""
    return frame.select(*[F.col(name).alias(name) for name in frame.columns])


def matrix(table: pa.Table, dim: int) -> np.ndarray:
    """The vectors of a group as rows."""
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, dim)


def ids(table: pa.Table) -> np.ndarray:
    return table.column("vec_id").to_numpy()


def row_numbers(table: pa.Table) -> np.ndarray:
    return table.column("row").to_numpy()
