"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are scaled to length 1 and rounded to 8 bits; the length of what rounding took away
bounds the error of every product. A task multiplies a tile of queries with a tile of
candidates in integers (exact in float32), and only pairs whose upper bound reaches the k-th
best so far are computed again in double precision from the original vectors. Each query's
best are kept in a heap while its tile meets more candidates, and the heaps of all tasks are
merged in the end. The bounds are proven, so the result is exact.

Tiles meet in cells of a grid: a cell has a bounded number of queries and any number of
candidate tiles, one after another. A side is copied once per row or column of the grid.

Edge cases. Vectors that are null, empty, zero, or hold null, NaN or infinite components take
no part, nor do null ids. Only vectors of equal dimension are compared. A query that is
repeated is asked once (of several vectors, the smallest); rows with the query's id never
answer it; other repeated rows answer each. Ties go to the smaller id. Empty tables give
empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronosift.session import pinned

NEIGHBOURS = 5
TILE, QUERY_TILE = 4096, 1024
# Most candidates and queries of one cell.
CELL_CANDIDATES, CELL_QUERIES = 131_072, 65_536
HELD_TILES = CELL_QUERIES // QUERY_TILE
PAIRS = 65_536

FIELDS = "dim int, ids binary, vectors binary, codes binary, scales binary, errors binary"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error bounds of the unit vectors."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    errors = np.linalg.norm(unit - codes * scales[:, None], axis=1)
    return codes, scales, errors


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def tile(dim: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            codes, scales, errors = quantised(vectors)
            parts = [ids.astype("<i8"), vectors, codes, scales, errors]
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                names=["dim", "ids", "vectors", "codes", "scales", "errors"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(lengths):
                rows = np.nonzero(lengths == dim)[0]
                flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                parts = held.setdefault(int(dim), [])
                parts.append((ids[rows], flat.astype(np.float64).reshape(-1, dim)))
                if sum(len(p[0]) for p in parts) >= size:
                    all_ids, all_vectors = (np.concatenate(x) for x in zip(*parts))
                    for at in range(0, len(all_ids) - size + 1, size):
                        yield tile(int(dim), all_ids[at:at + size], all_vectors[at:at + size])
                    at = len(all_ids) // size * size
                    held[int(dim)] = [(all_ids[at:], all_vectors[at:])] if at < len(all_ids) else []
        for dim, parts in held.items():
            if parts:
                yield tile(dim, *(np.concatenate(x) for x in zip(*parts)))
    return run


class _Tile:
    def __init__(self, dim: int, ids: bytes, vectors: bytes, codes: bytes, scales: bytes, errors: bytes):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.vectors = np.frombuffer(vectors).reshape(-1, dim)
        exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        self.codes = np.frombuffer(codes, dtype=np.int8).reshape(-1, dim).astype(exact)
        self.scales, self.errors = np.frombuffer(scales), np.frombuffer(errors)
        norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        if not (np.isfinite(norms) & (norms > 1e-150)).all():  # squares left the range of doubles
            self.vectors = self.vectors / np.abs(self.vectors).max(axis=1, keepdims=True)
            norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.norms = norms


def _best(queries: _Tile, tile: _Tile, floor: np.ndarray, k: int, rows: slice):
    """Query positions, ids and scores of the ``k`` best of ``tile`` for queries ``rows``."""
    product = queries.codes[rows] @ tile.codes.T
    guess = product * queries.scales[rows][:, None] * tile.scales
    # |u.v - u'.v'| <= |u'| |v - v'| + |v| |u - u'|, |v| = 1, |u'| <= 1 + |u - u'|; and rounding.
    slack = (1 + queries.errors[rows])[:, None] * tile.errors + queries.errors[rows][:, None] + 1e-9
    same = np.isin(queries.ids[rows], tile.ids)
    for i in np.nonzero(same)[0]:
        guess[i, tile.ids == queries.ids[rows][i]] = -np.inf
    least = floor[rows]
    if guess.shape[1] >= k:
        sure = np.partition(guess - slack, guess.shape[1] - k, axis=1)[:, guess.shape[1] - k]
        least = np.maximum(least, sure)
    q, c = np.nonzero((guess + slack >= least[:, None]) & np.isfinite(guess))
    kept_q, kept_c, kept_s = [], [], []
    for at in range(0, len(q), PAIRS):
        a, b = q[at:at + PAIRS] + rows.start, c[at:at + PAIRS]
        score = (queries.vectors[a] * tile.vectors[b]).sum(axis=1) / (queries.norms[a] * tile.norms[b])
        order = np.lexsort((tile.ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        kept_q.append(a[nth < k])
        kept_c.append(tile.ids[b[nth < k]])
        kept_s.append(score[nth < k])
    if not kept_q:
        return ()
    return zip(np.concatenate(kept_q).tolist(), np.concatenate(kept_c).tolist(), np.concatenate(kept_s).tolist())


def _matched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[_Tile, list[list[tuple[float, int]]], np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            found = [(int(t.ids[i]), -minus, score) for t, heaps, _ in held.values()
                     for i, heap in enumerate(heaps) for score, minus in heap]
            held.clear()
            columns = list(zip(*found)) if found else [[], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(j)[i].as_py() for j in range(batch.num_columns)]
                dim, tile, asked = row[0], _Tile(row[0], *row[1:6]), row[6:]
                name = (dim, int(np.frombuffer(asked[0][:8], dtype="<i8")[0]))
                if name not in held:
                    if len(held) >= HELD_TILES:
                        yield flush()
                    queries = _Tile(dim, *asked)
                    held[name] = (queries, [[] for _ in queries.ids], np.full(len(queries.ids), -np.inf))
                queries, heaps, floor = held[name]
                for at in range(0, len(queries.ids), 256):
                    for q, vec_id, score in _best(queries, tile, floor, k, slice(at, min(at + 256, len(queries.ids)))):
                        heap = heaps[q]
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -vec_id))
                        elif (score, -vec_id) > heap[0]:
                            heapq.heapreplace(heap, (score, -vec_id))
                        if len(heap) == k:
                            floor[q] = heap[0][0]
        yield flush()
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``vectors`` by cosine."""
    def valid(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("bigint").alias("vec_id"),
                         F.col(vector).cast("array<double>").alias("v")).filter(
            F.col("vec_id").isNotNull() & usable(F.col("v")))

    candidates = valid(vectors)
    asked = valid(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    threads = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = vectors.count(), queries.count()
    columns = max(1, -(-n // CELL_CANDIDATES), min(threads, -(-n // TILE)))
    rows = max(1, -(-m // CELL_QUERIES))
    tiles = candidates.mapInArrow(_packed(TILE), FIELDS)
    tiles = tiles.withColumn("column", F.pmod(F.xxhash64("ids"), F.lit(columns))).withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    other = pinned(asked.mapInArrow(_packed(QUERY_TILE), FIELDS))
    other = other.withColumn("row", F.pmod(F.xxhash64("ids"), F.lit(rows))).withColumn(
        "column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    names = ["ids", "vectors", "codes", "scales", "errors"]
    other = other.select("dim", "row", "column", *[F.col(c).alias(f"q_{c}") for c in names])
    met = tiles.join(other, ["dim", "row", "column"]).select("dim", *names, *[f"q_{c}" for c in names])
    found = met.mapInArrow(_matched(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
