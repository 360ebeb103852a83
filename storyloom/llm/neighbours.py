"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks of about ``block_rows`` rows and queries into blocks of about
``block_queries``.  Every query block meets every vector block once: a tile.  In a tile vectors and
queries are rounded to int8 with a scale of their own, and one product of int8 tiles gives all rounded
distances.  A rounded vector is off by a known distance, so a true distance differs from the rounded
one by at most the sum of the two: pairs whose least possible distance is above the greatest possible
distance of the query's k-th nearest are gone.  Surviving pairs are measured in double precision on
the original vectors and go through a heap of k per query.  The heaps of the tiles of a query are
merged by heaps in rounds, so that no group has more than the lists of ``merge_fan`` blocks.

The result is exact: rounding chooses what is measured, never the order.  Work is queries times
vectors, as the search of a stated query set in blocks is; a tile's memory is bounded by the two block
sizes, and a third of all vectors being equal changes neither, as blocks are dealt by vec_id.

Nulls, ties and repeated rows: vectors that are null, empty, zero or hold a null or non-finite number,
and rows without vec_id, take no part.  Rows of one vec_id count once: the smallest vector of them.
Vectors of different lengths have no distance and are not compared.  Ties go to the smaller vec_id.
A query has fewer rows if there are fewer candidates; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest vectors whose int8 products a float32 still sums exactly: 127 * 127 * 1040 < 2 ** 24.
_EXACT = 1040


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (doubles) and ``dim`` of the vectors that take part, one row for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    sound = rows.where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    return sound.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the squared lengths of the rounded rows and how far each is off its row."""
    scale = np.abs(x).max(1) / 127
    whole = np.rint(x / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, (back**2).sum(1), np.sqrt(((x - back) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All int8 products of two tiles, exact: as float32 for short rows, in pieces of them for long ones."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], _EXACT):
        total += a[:, at : at + _EXACT].astype(np.float32) @ b[:, at : at + _EXACT].astype(np.float32).T
    return total


def distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, each summed over the components in their order."""
    return np.sqrt(np.cumsum((rows - query) ** 2, axis=1)[:, -1])


def merged(lists: Iterator[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The ``k`` nearest, nearest first, ties to the smaller vec_id."""
    return heapq.nsmallest(k, lists)


def tile(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int, strip: int = 4096) -> Iterator[tuple[int, list[float], list[int]]]:
    """The ``k`` nearest rows of each query (ids and vectors on both sides), a query's own id left out.

    Rows are taken in strips; what a strip leaves in a query's heap bounds the next one.
    """
    q_id, q = queries
    r_id, r = rows
    q8, q_scale, q_square, q_off = rounded(q)
    best: list[list[tuple[float, int]]] = [[] for _ in q_id]
    for at in range(0, len(r_id), strip):
        ids, x = r_id[at : at + strip], r[at : at + strip]
        x8, x_scale, x_square, x_off = rounded(x)
        square = q_square[:, None] + x_square[None, :] - 2 * products(q8, x8) * q_scale[:, None] * x_scale[None, :]
        middle = np.sqrt(np.maximum(square, 0))
        # The last term covers what double arithmetic loses in the square, in either direction.
        off = q_off[:, None] + x_off[None, :] + 1e-7 * np.sqrt(q_square[:, None] + x_square[None, :])
        least, most = middle - off, middle + off
        own = q_id[:, None] == ids[None, :]
        least[own] = most[own] = np.inf
        kth = np.partition(most, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(q_id), np.inf)
        for n, (near, bound) in enumerate(zip(best, kth, strict=True)):
            if len(near) == k:
                bound = min(bound, near[-1][0])
            left = np.flatnonzero((least[n] <= bound) & ~own[n])
            if len(left):
                found = zip(distances(q[n], x[left]).tolist(), ids[left].tolist(), strict=True)
                best[n] = merged([*near, *found], k)
    for who, near in zip(q_id.tolist(), best, strict=True):
        yield who, [d for d, _ in near], [i for _, i in near]


def search(vectors: DataFrame, every: int = 100, k: int = 10, block_rows: int = 32_768, block_queries: int = 1_024, merge_fan: int = 64) -> DataFrame:
    """The ``k`` nearest of each query, the vectors whose vec_id is divisible by ``every``.

    Returns query_id, rank from 1, vec_id and score, the Euclidean distance.
    """
    rows = usable(vectors)
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    row_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // block_queries))
    deal = lambda blocks, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks)).cast("int")
    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", "dim", deal(query_blocks, 1).alias("qb"), blocks(row_blocks).alias("rb"))
    # New names, as a frame grouped beside another of the same columns would lose them.
    right = rows.select(F.col("vec_id").alias("r_id"), F.col("v").alias("r"), F.col("dim").alias("r_dim"), deal(row_blocks, 2).alias("r_block"), blocks(query_blocks).alias("q_block"))

    def framed(query_id: list[int], rb: int, near: list[tuple[list, list]]) -> pd.DataFrame:
        lists = {name: pd.Series([x[n] for x in near], dtype=object) for n, name in enumerate(("d", "id"))}
        return pd.DataFrame({"query_id": np.array(query_id, np.int64), "rb": np.full(len(query_id), rb, np.int32), **lists})

    def one_tile(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return framed([], 0, [])
        pairs = (q["vec_id"], q["v"]), (r["r_id"], r["r"])
        found = [x for x in tile(*[(ids.to_numpy(), np.stack(v.to_numpy())) for ids, v in pairs], k) if x[1]]
        return framed([x[0] for x in found], int(r["r_block"].iloc[0]), [x[1:] for x in found])

    lists = left.groupBy("qb", "rb", "dim").cogroup(right.groupBy("q_block", "r_block", "r_dim")).applyInPandas(one_tile, "query_id long, rb int, d array<double>, id array<long>")

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        near = merged((pair for d, i in zip(f["d"], f["id"], strict=True) for pair in zip(d, i, strict=True)), k)
        return framed([int(f["query_id"].iloc[0])], int(f["rb"].iloc[0]), [([d for d, _ in near], [i for _, i in near])])

    while row_blocks > 1:
        group = F.floor(F.col("rb") / merge_fan).cast("int")
        lists = lists.withColumn("rb", group).groupBy("query_id", "rb").applyInPandas(merge, lists.schema)
        row_blocks = -(-row_blocks // merge_fan)
    return lists.select("query_id", F.posexplode(F.arrays_zip("d", "id"))).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), F.col("col.d").alias("score")
    )


def op2(vectors: DataFrame) -> DataFrame:
    return search(vectors)


#: Each query against every candidate, by DuckDB; squares are summed in the components' order, as here.
ORACLE = """
WITH v AS (
  SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
