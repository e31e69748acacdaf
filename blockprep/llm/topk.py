"""Exact top-k search by inner product, block at a time with pruning.

Vectors are cut into whole numbers; a dimension is a term.  Candidates are dealt into tiles of
bounded size; in a tile, vectors in a space-filling order form blocks, each with the largest
and least value of every term and a forward index (its rows).  A query's bound for a block is
the sum over terms of the most that the query's weight can make of them.  A query takes the
tile's blocks from the highest bound down and stops when the bound falls below its k-th score,
so that blocks that cannot matter are never scored.  Tiles meet chunks of queries by an equi
join on their numbers; each pair gives at most k rows a query, and these are merged.

Vectors that are NULL or hold NULL or non-finite components take no part, nor do empty ones,
nor vectors without an id; vectors of another length than the query's are not its candidates.
Ties go to the smaller id; rows that share an id are candidates each for itself, but no
query finds rows of its own id; query rows that share an id give one list, where a row may
stand once for each of them.  Scores beyond 64 bits are the nearest long, components beyond
them too, and tie with others so cut.  A query with no candidates gives no rows.  An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a tile, queries in a chunk, vectors in a block.
TILE, CHUNK, BLOCK = 8192, 1024, 64
_EXACT = 2.0**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """Usable rows (id, v, d): components times ``scale``, rounded down, and their number."""
    own = F.col(f"`{vector}`")
    usable = own.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & (F.size(own) > 0)
    whole = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    values = F.transform(own, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.where(usable & whole).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), values.alias("v"), F.size(own).alias("d")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _numbers(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where every sum is exact in them, else as Python's own numbers."""
    most = float(np.abs(queries.astype(float)).max()) * float(np.abs(rows.astype(float)).max()) * queries.shape[1]
    kind = float if most < _EXACT else object
    return queries.astype(kind), rows.astype(kind)


def curve_order(rows: np.ndarray) -> np.ndarray:
    """Vectors that point alike come together: ordered by their largest term, then its size."""
    weight = np.abs(rows.astype(float))
    lead = weight.argmax(axis=1)
    at = np.arange(len(rows))
    sign = rows[at, lead] < 0
    weight[at, lead] = -1
    return np.lexsort((weight.argmax(axis=1), sign, lead))


def search_tile(
    ids: np.ndarray, rows: np.ndarray, asked: np.ndarray, queries: np.ndarray, k: int, block: int = BLOCK, longs: bool = False
):
    """(query, id, score) of each query's k best rows in a tile, and the number of rows scored.

    With ``longs``, scores beyond 64 bits are cut to them before they are compared.
    """
    order = curve_order(rows)
    ids, rows = ids[order], rows[order]
    queries, rows = _numbers(queries, rows)
    edges = np.arange(0, len(rows), block)
    most, least = np.maximum.reduceat(rows, edges), np.minimum.reduceat(rows, edges)
    zero = queries * 0
    bounds = np.maximum(queries, zero) @ most.T + np.minimum(queries, zero) @ least.T
    ranks = np.argsort(-bounds.astype(float), axis=1, kind="stable")
    out, scored = [], 0
    for q, number in enumerate(asked.tolist()):
        best_ids, best = np.empty(0, np.int64), rows[:0, 0]
        for b in ranks[q]:
            if len(best) == k and bounds[q, b] < best[-1]:
                break  # an equal bound may still hold a smaller id
            part = slice(b * block, (b + 1) * block)
            scores = rows[part] @ queries[q]
            if longs and scores.dtype == object:
                scores = np.clip(scores, _LEAST, _MOST)
            scored += len(scores)
            near = ids[part] != number
            if len(best) == k:
                near &= scores >= best[-1]
            if not near.any():
                continue
            best_ids = np.concatenate([best_ids, ids[part][near]])
            best = np.concatenate([best, scores[near]])
            first = np.lexsort((best_ids, -best.astype(float)) if best.dtype != object else (best_ids, [-x for x in best]))[:k]
            best_ids, best = best_ids[first], best[first]
        out.extend((number, int(i), int(s)) for i, s in zip(best_ids, best))
    return out, scored


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        width = key[2].as_py()
        ids, asked = rows.column("id").to_numpy(), queries.column("id").to_numpy()
        found, _ = search_tile(ids, _matrix(rows.column("v"), width), asked, _matrix(queries.column("v"), width), k, longs=True)
        return pa.Table.from_pylist([dict(zip(_FOUND.names, row)) for row in found], _FOUND)

    return run


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    tile: int = TILE,
    chunk: int = CHUNK,
) -> DataFrame:
    """Per query its k highest scores: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``."""
    rows, asked = quantised(df, vec_id, vector, scale), quantised(queries, vec_id, vector, scale)
    tiles, chunks = max(1, -(-rows.count() // tile)), max(1, -(-asked.count() // chunk))
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("tile", deal(tiles)).withColumn("chunk", every(chunks))
    asked = asked.withColumn("chunk", deal(chunks)).withColumn("tile", every(tiles))
    found = (
        rows.groupBy("tile", "chunk", "d")
        .cogroup(asked.groupBy("tile", "chunk", "d"))
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
