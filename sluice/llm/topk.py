"""Exact top-k search by inner product: columnar branch and bound.

Vectors are quantised to integers, floor(256 * x). Candidates are stored vertically, a row per
dimension, a block of candidates at a time. Scores build up one block of dimensions at a time,
those where the query is largest first. After each, what a candidate can still gain is bounded
by the mass that remains, the norms of what is left of both vectors (Cauchy-Schwarz). The most
promising candidates are scored in full to raise the query's k-th best score, candidates whose bound does
not reach it are dropped, and the survivors' columns are compacted before the next block of
dimensions. A task carries each query's k best from one block of candidates to the next, so
later blocks start from a high k-th best. It is always a score that k candidates reach, so no
result is lost.

The query set is stated (a predicate on the id). Candidates stay in the partitions they are in.
Queries are packed in blocks, and the blocks meet the candidates in groups of at most
``broadcast_bytes`` that are sent to every task: one pass over the candidates for each group. A
task hands on k rows for each query.

Numbers: rows whose components are too large for sums that are exact in floating point are
searched in the same way in whole numbers of any length. Scores beyond 64 bits are held at its
limits and rank as such.

Definitions: vectors that are null or hold null or non-finite components, and rows without id,
take no part; an empty vector scores 0. "Every row but the query's own" is read as all rows of
other ids, with vectors of its length. Rows that repeat id and vector are one query, but each
repeated row is a candidate. Ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm._shared import save, scratch_path, tune

#: Candidates in a block at most, queries in one, values in either, and dimensions added at a time.
CANDIDATES, QUERIES, VALUES, DIMS = 4096, 1024, 1 << 18, 16
#: Bytes of queries that meet the candidates in one pass.
BROADCAST_BYTES = 32 << 20
_LIMIT = 2**63 - 1


def taking_part(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part; v holds floats as they are stored, anything else as doubles."""
    kind = vectors.schema[vector].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType)
    v = F.col(f"`{vector}`") if plain else F.col(f"`{vector}`").cast("array<double>")
    out = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~out)


def _blocks(batches, size: int):
    """(ids, float64 matrix) of up to ``size`` vectors of one length, from Arrow batches (id, v)."""
    held: dict[int, list] = {}

    def block(dim):
        ids, flat = (np.concatenate(x) for x in zip(*held.pop(dim)))
        return ids, flat.reshape(len(ids), dim)

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        at = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        dims = np.diff(at)
        for dim in np.unique(dims).tolist():
            own, most = np.flatnonzero(dims == dim), max(1, min(size, VALUES // max(1, dim)))
            while len(own):
                part = own[: most - sum(len(x[0]) for x in held.get(dim, []))]
                held.setdefault(dim, []).append((ids[part], values[(at[part][:, None] + np.arange(dim)).ravel()]))
                own = own[len(part) :]
                if sum(len(x[0]) for x in held[dim]) >= most:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component as a whole number of any length."""
    number = lambda x: math.floor(x * 256.0) if abs(x) < 1e300 else int(x) * 256
    return np.array([[number(x) for x in v] for v in values.tolist()], object).reshape(values.shape)


class Floats:
    """Arithmetic in doubles that hold every sum exactly."""

    @staticmethod
    def reach(part: np.ndarray, q_left: float, p_left: np.ndarray) -> np.ndarray:
        """The most a score can become, from the squared norms of what is left."""
        return part + np.sqrt(q_left * p_left) * (1 + 1e-9) + 1e-3

    @staticmethod
    def score(part: np.ndarray) -> np.ndarray:
        return part.astype(np.int64)


class Wholes:
    """Arithmetic in whole numbers of any length; bounds and scores are held within 64 bits."""

    @staticmethod
    def reach(part: np.ndarray, q_left: int, p_left: np.ndarray) -> np.ndarray:
        return Wholes.score([s + math.isqrt(int(q_left * p)) + 1 for s, p in zip(part, p_left)])

    @staticmethod
    def score(part) -> np.ndarray:
        return np.array([max(-_LIMIT - 1, min(_LIMIT, int(x))) for x in part], np.int64)


class Best:
    """The k best of all candidates seen so far, for every query of a block."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, k: int):
        self.values, self.ids, self.k = values, ids, k
        self.scores = np.zeros((len(ids), k), np.int64)
        self.found = np.zeros((len(ids), k), np.int64)
        self.count = np.zeros(len(ids), np.int64)
        #: Candidates left after each block of dimensions, over all queries and blocks of candidates.
        self.survivors: dict[int, int] = {}
        safe = math.sqrt(2.0**53 / max(1, values.shape[1])) / 256
        self.safe, self.narrow = safe, np.abs(values).max(1, initial=0) < safe
        self.floats, self.wholes = np.floor(values[self.narrow] * 256.0), None

    def add(self, pool: np.ndarray, pool_ids: np.ndarray) -> None:
        """Search a block of candidates."""
        narrow = np.abs(pool).max(1, initial=0) < self.safe
        if narrow.any() and self.narrow.any():
            self._search(np.flatnonzero(self.narrow), self.floats, np.floor(pool[narrow] * 256.0), pool_ids[narrow], Floats)
        if narrow.all() and self.narrow.all():
            return
        if self.wholes is None:
            self.wholes = whole(self.values)
        exact = whole(pool)
        if not narrow.all():
            self._search(np.flatnonzero(self.narrow), self.wholes[self.narrow], exact[~narrow], pool_ids[~narrow], Wholes)
        self._search(np.flatnonzero(~self.narrow), self.wholes[~self.narrow], exact, pool_ids, Wholes)

    def _search(self, rows: np.ndarray, queries: np.ndarray, pool: np.ndarray, pool_ids: np.ndarray, kind) -> None:
        dim, k = queries.shape[1], self.k
        upright = np.ascontiguousarray(pool.T)
        mass = (pool * pool).sum(1)
        for row, q in zip(rows.tolist(), queries):
            alive = np.flatnonzero(pool_ids != self.ids[row])
            part, left, q_left = np.zeros(len(alive), pool.dtype), mass[alive], (q * q).sum()
            order = np.argsort(-np.abs(q), kind="stable")
            for n, dims in enumerate(np.split(order, range(DIMS, dim, DIMS))):
                block = upright[dims][:, alive] if len(alive) < len(pool) else upright[dims]
                part, left, q_left = part + q[dims] @ block, left - (block * block).sum(0), q_left - (q[dims] * q[dims]).sum()
                bound = kind.reach(part, q_left, left)
                floor = self.scores[row, k - 1] if self.count[row] >= k else None
                if len(alive) > k and (n + 1) * DIMS < dim:  # full scores of the most promising raise the k-th best
                    likely = alive[np.argpartition(-bound.astype(np.float64), k - 1)[:k]]
                    raised = kind.score(q @ upright[:, likely]).min()
                    floor = raised if floor is None else max(floor, raised)
                if floor is not None:
                    keep = bound >= floor
                    alive, part, left = alive[keep], part[keep], left[keep]
                self.survivors[n] = self.survivors.get(n, 0) + len(alive)
            self._keep(row, kind.score(part), pool_ids[alive])

    def _keep(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.count[row]
        scores, ids = np.concatenate([self.scores[row, :n], scores]), np.concatenate([self.found[row, :n], ids])
        # a complement, since the least score has no negative
        best = np.lexsort((ids, ~scores))[: self.k]
        self.count[row] = len(best)
        self.scores[row, : len(best)], self.found[row, : len(best)] = scores[best], ids[best]


def _packed(rows: DataFrame) -> DataFrame:
    """Blocks (dim, ids, flat, size) of queries; flat holds float64 values, vector by vector."""

    def run(batches):
        for ids, values in _blocks(batches, QUERIES):
            columns = [pa.array([values.shape[1]], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([values.astype("<f8").tobytes()]), pa.array([8 * (ids.size + values.size)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "flat", "size"])

    return rows.mapInArrow(run, "dim int, ids binary, flat binary, size long")


def _met(rows: DataFrame, group: list, k: int) -> DataFrame:
    """(block, at, query_id, vec_id, score): each task's k best for every query of the group's blocks (block, dim, ids, flat)."""
    held = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in group])  # at most broadcast_bytes

    def run(batches):
        best: dict[int, list[tuple[int, Best]]] = {}
        for block, dim, ids, flat in held.value:
            ids = np.frombuffer(ids, "<i8")
            best.setdefault(dim, []).append((block, Best(np.frombuffer(flat, "<f8").reshape(len(ids), dim), ids, k)))
        for pool_ids, pool in _blocks(batches, CANDIDATES):
            for _, b in best.get(pool.shape[1], ()):
                b.add(pool, pool_ids)
        for block, b in (x for found in best.values() for x in found):
            at = np.repeat(np.arange(len(b.ids)), b.count)
            inside = np.arange(k)[None, :] < b.count[:, None]
            columns = [np.full(len(at), block), at, b.ids[at], b.found[inside], b.scores[inside]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "at", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "block long, at long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates, rank from 1.

    ``is_query``: a predicate over a column named ``id``.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = taking_part(vectors, id_col, vector)
    blocks = save(_packed(rows.where(is_query).dropDuplicates(["id", "v"])), "topk-queries")
    blocks = save(blocks.withColumn("block", F.monotonically_increasing_id()), "topk-query-blocks")
    groups, size = [[]], 0
    for block, n in (tuple(r) for r in blocks.select("block", "size").orderBy("block").collect()):  # two numbers for each 2 MB of queries
        if groups[-1] and size + n > broadcast_bytes:
            groups.append([])
            size = 0
        groups[-1].append(block)
        size += n
    path, found = scratch_path(spark, "topk-found"), None
    for group in groups:
        own = blocks.where(F.col("block").between(group[0], group[-1])) if group else blocks
        met = _met(rows, own.select("block", "dim", "ids", "flat").collect(), k)
        found = met if len(groups) == 1 else save(met, "topk-found", path)
    order = Window.partitionBy("block", "at").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
