"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are sparse term vectors whose terms are their components. A range of vectors is put in an order in which
like ones stand together and is cut into blocks; a block's forward index is its matrix, and its term maxima (and
minima, for negative query weights) bound every score in it. For each query, blocks are taken in the order of their
bounds, and scored until the best bound left lies below the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, blocks scored between two looks at the bounds, and vectors in a range, which one task holds.
BLOCK, STEP, RANGE = 64, 8, 32_768
#: Scores are longs; beyond them they are the greatest or least long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def matrix_of(column: pa.ListArray) -> np.ndarray:
    """Component rows as one matrix; shorter vectors lack the later terms, which count as zero."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def wider(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix


def like_together(matrix: np.ndarray) -> np.ndarray:
    """An order of the rows: halves along the axis of the widest spread, and their halves, down to single blocks."""
    parts, out = [np.arange(len(matrix))], []
    while parts:
        rows = parts.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            own = matrix[rows] - matrix[rows].mean(0)
            axis = own[np.abs(own).sum(1).argmax()]
            for _ in range(3):
                axis = own.T @ (own @ axis)
                axis = axis / max(np.abs(axis).max(initial=0), 1e-300)
            place = np.argsort(np.nan_to_num(own @ axis), kind="stable")
        half = -(-len(rows) // (2 * BLOCK)) * BLOCK
        parts += [rows[place[half:]], rows[place[:half]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Blocks:
    """The forward indexes of one range."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = like_together(matrix)
        self.ids, matrix = ids[order], matrix[order]
        pad = -len(matrix) % BLOCK
        self.n, self.width = len(matrix), matrix.shape[1]
        self.index = np.concatenate([matrix, np.zeros((pad, self.width))]).reshape(-1, BLOCK, self.width)
        tail = self.index.copy()
        if pad:
            tail[-1, BLOCK - pad :] = tail[-1, 0]
        self.most, self.least = tail.max(1), tail.min(1)
        #: Sums of products are exact in doubles below 2^53; beyond, Python's integers are used.
        self.peak = np.abs(matrix).max(initial=0)
        self.scored = 0

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) but those with the query's own id, ties to smaller ids."""
        floor = -np.inf
        width = min(self.width, len(query))
        q = query[:width]
        if not (self.peak < 2.0**52 and self.peak * np.abs(q).max(initial=0) * max(1, width) < 2.0**52):
            return self._exact(own, q, k)
        bound = self.most[:, :width] @ np.maximum(q, 0) + self.least[:, :width] @ np.minimum(q, 0)
        order = np.argsort(-bound, kind="stable")
        scores, ids = np.zeros(0), np.zeros(0, dtype=np.int64)
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            some = some[bound[some] >= floor]
            if not len(some):
                break
            self.scored += len(some)
            rows = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = (self.index[some, :, :width].reshape(-1, width) @ q)[rows < self.n]
            near = self.ids[rows[rows < self.n]]
            keep = (near != own) & (found >= floor)
            scores, ids = np.concatenate([scores, found[keep]]), np.concatenate([ids, near[keep]])
            if len(scores) > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            if len(scores) == k:
                floor = max(floor, scores.min())
        best = np.lexsort((ids, -scores))[:k]
        return [(int(scores[i]), int(ids[i])) for i in best]

    def _exact(self, own: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The same in whole numbers of any size, every block scored."""
        whole = [int(x) for x in q]
        flat = self.index.reshape(-1, self.width)[: self.n]
        self.scored += len(self.index)
        found = sorted((-max(LEAST, min(MOST, sum(int(a) * b for a, b in zip(row, whole)))), int(i)) for row, i in zip(flat, self.ids) if i != own)
        return [(-s, i) for s, i in found[:k]]


def integer_terms(vector: Column) -> Column:
    """floor(256 x) of each component; null for vectors that are null or hold a null or non-finite component.

    From 2^52 on a double is a whole number itself. A product beyond the doubles is the greatest double.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    top = F.lit(1.7976931348623157e308)

    def term(v):
        y = v * 256
        return F.when(F.abs(y) < 2.0**52, F.floor(F.when(F.abs(y) < 2.0**52, y).otherwise(0.0)).cast("double")).otherwise(F.greatest(-top, F.least(top, y)))

    return F.when(good, F.transform(x, term))


def top_k(df: DataFrame, is_query: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 5, in_range: int = RANGE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to smaller ids.

    A query's own row is no candidate (any row with its id). Vectors that are null, or hold a null or non-finite component,
    and rows with a null id take no part; vectors of different lengths share their leading terms. Repeated rows
    are candidates each; of several query rows with one id the one with the least vector asks. Scores beyond a
    long are the greatest or least long. Fewer than ``k`` candidates give fewer ranks; an empty table gives no rows.

    Candidates are dealt into ranges once, and each query goes to every range: no candidate is sent twice, and
    a task holds one range and a batch of queries.
    """
    rows = df.select(F.col(f"`{id}`").cast("long").alias("id"), integer_terms(F.col(f"`{vector}`")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null")
    n = rows.count()  # one number
    ranges = max(1, -(-n // in_range), min(df.sparkSession.sparkContext.defaultParallelism, n // (16 * BLOCK)))
    candidates = rows.select(F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int").alias("r"), F.lit(0).alias("kind"), "id", "v")
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    queries = queries.select(F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("r"), F.lit(1).alias("kind"), "id", "v")

    def search(batches):
        held, blocks, here = [], None, None
        for batch in batches:
            r, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (kind[1:] != kind[:-1])]) if len(r) else np.zeros(0, np.int64)
            out = []
            for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)]):
                if r[start] != here:
                    held, blocks, here = [], None, r[start]
                some = matrix_of(batch.column(3).slice(start, stop - start)), ids[start:stop]
                if not kind[start]:
                    held.append(some)
                    continue
                if blocks is None and held:
                    width = max(m.shape[1] for m, _ in held)
                    blocks = Blocks(np.concatenate([i for _, i in held]), np.concatenate([wider(m, width) for m, _ in held]))
                    held = []
                if blocks is not None:
                    out += [(own, i, s) for query, own in zip(some[0], some[1].tolist()) for s, i in blocks.search(own, query, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    met = candidates.unionByName(queries).repartition(ranges, "r").sortWithinPartitions("r", "kind")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
