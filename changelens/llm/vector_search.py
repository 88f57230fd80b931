"""Exact search for the largest inner products, by statistics of segments at several resolutions.

A vector is cut into 1, 4 and then 16 segments; of each segment the mean and the deviation are kept. Two vectors are at
least as far apart as the segments' means and deviations say, so with the vectors' lengths these bounds limit the inner
product. For each query, candidates that cannot reach its best ones any more leave at the coarsest level that shows it;
only for the rest the whole vectors are multiplied.

Rows are packed into blocks, each a row of bytes, and each block of queries meets the blocks of a chunk of candidates in
one task, which keeps its best so far. Nothing is collected or broadcast.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, written

#: Segments at each level, coarse to fine.
LEVELS = (1, 4, 16)
#: Rows of a block of candidates, and of queries; blocks of candidates that a block of queries meets in a row.
ROWS, QUERY_ROWS, CHUNK = 4_096, 1_024, 16
#: Candidates compared in full to have a first threshold, and pairs handled at once.
FIRST, PAIRS = 32, 1 << 18
#: From this share of survivors on, a level takes all pairs of two blocks at once.
DENSE = 0.125
#: Pairs of blocks that are handed to Python at a time.
BATCH = 8
#: Beyond this, products of doubles are not exact and whole numbers are used.
EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, weighted by its length: their squares sum up to the vector's squared length."""
    parts = []
    for part in np.array_split(vectors, min(segments, vectors.shape[1]), axis=1):
        parts += [part.mean(1) * np.sqrt(part.shape[1]), part.std(1) * np.sqrt(part.shape[1])]
    return np.stack(parts, 1) if parts else np.zeros((len(vectors), 1))


def lower_distances(q: np.ndarray, c: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Least squared distances by the statistics of two sets of vectors with these sums of squared lengths."""
    return squares - 2 * (q @ c.T)


class Block:
    """Vectors with their ids and numbers, and their statistics once asked for."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        self.ids, self.known, self.rows, self.vectors = ids, known, rows, vectors
        self.squares = (vectors * vectors).sum(1)
        self._levels: dict[int, np.ndarray] = {}

    def level(self, segments: int) -> np.ndarray:
        if segments not in self._levels:
            self._levels[segments] = statistics(self.vectors, segments)
        return self._levels[segments]

    def packed(self) -> bytes:
        n, width = self.vectors.shape
        parts = [self.ids.astype("<i8"), self.known.astype("u1"), self.rows.astype("<i8"), self.vectors.astype("<f8")]
        return struct.pack("<qq", n, width) + b"".join(p.tobytes() for p in parts)

    @staticmethod
    def of(data: bytes) -> Block:
        n, own = struct.unpack_from("<qq", data)
        ids, known = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "u1", n, 16 + 8 * n).astype(bool)
        rows = np.frombuffer(data, "<i8", n, 16 + 9 * n)
        return Block(ids, known, rows, np.frombuffer(data, "<f8", n * own, 16 + 17 * n).reshape(n, own))

    def widened(self, width: int) -> Block:
        """Missing components count as zero."""
        if self.vectors.shape[1] >= width:
            return self
        more = np.zeros((len(self.ids), width - self.vectors.shape[1]))
        return Block(self.ids, self.known, self.rows, np.hstack([self.vectors, more]))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products row by row of whole numbers, exact, kept within the range of a long."""
    if len(q) == 0:
        return np.zeros(0, np.int64)
    largest = np.sqrt((q * q).sum(1).max() * (c * c).sum(1).max())
    if largest < EXACT:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    sums = (sum(int(x) * int(y) for x, y in zip(a, b)) for a, b in zip(q, c))
    return np.array([min(max(s, _LONG[0]), _LONG[1]) for s in sums], np.int64)


class Best:
    """The k best candidates so far of each query of a block."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.query = np.zeros(0, np.int64)
        self.score, self.ids, self.known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, known = np.concatenate([self.ids, ids]), np.concatenate([self.known, known])
        order = np.lexsort((ids, ~known, -score, query))
        first = np.searchsorted(query[order], query[order])
        order = order[np.arange(len(order)) - first < self.k]
        self.query, self.score, self.ids, self.known = query[order], score[order], ids[order], known[order]

    def thresholds(self) -> np.ndarray:
        """The k-th best score of each query, below which nothing counts."""
        least = np.full(len(self.queries.ids), -np.inf)
        counts = np.bincount(self.query, minlength=len(least))
        ends = np.cumsum(counts)
        full = counts >= self.k
        least[full] = self.score[ends[full] - 1]
        return least

    def compared(self, candidates: Block, query: np.ndarray, candidate: np.ndarray, known: np.ndarray | None = None) -> None:
        """Compare these pairs in full; ``known``: their products, if all pairs of the blocks were multiplied at once."""
        other = self.queries.rows[query] != candidates.rows[candidate]
        query, candidate, known = query[other], candidate[other], None if known is None else known[other]
        for at in range(0, len(query), PAIRS):
            q, c = query[at : at + PAIRS], candidate[at : at + PAIRS]
            score = products(self.queries.vectors[q], candidates.vectors[c]) if known is None else known[at : at + PAIRS].astype(np.int64)
            counts = score >= self.thresholds()[q]
            q, c = q[counts], c[counts]
            self.add(q, score[counts], candidates.ids[c], candidates.known[c])

    def search(self, candidates: Block) -> int:
        """Add what a block of candidates has to give; the number of pairs that were compared in full."""
        width = max(self.queries.vectors.shape[1], candidates.vectors.shape[1])
        self.queries, candidates = self.queries.widened(width), candidates.widened(width)
        q, c, m, n = self.queries, candidates, len(self.queries.ids), len(candidates.ids)
        if not m or not n:
            return 0
        total, done = 0, max(1, PAIRS * 8 // n)
        for at in range(0, m, done):
            mine = np.arange(at, min(m, at + done))
            squares = q.squares[mine][:, None] + c.squares[None, :]
            slack = 1e-9 * squares + 1e-6  # rounding of the statistics
            distance = lower_distances(q.level(LEVELS[0])[mine], c.level(LEVELS[0]), squares) - slack
            short = ~np.isfinite(self.thresholds()[mine])
            if short.any():
                most = min(n, max(FIRST, self.k + 1))
                near = (distance - squares)[short]
                near = np.argpartition(near, most - 1, axis=1)[:, :most] if most < n else np.tile(np.arange(n), (len(near), 1))
                self.compared(c, np.repeat(mine[short], most), near.ravel())
                total += near.size
                seen = np.zeros(distance.shape, bool)
                seen[np.repeat(np.flatnonzero(short), most), near.ravel()] = True
            else:
                seen = None
            # A candidate counts while its distance may be as small as the threshold asks.
            wanted = squares - 2 * self.thresholds()[mine][:, None]
            left = ~(distance > wanted)  # what overflows stays in
            if seen is not None:
                left &= ~seen
            query, candidate = np.nonzero(left)
            for segments in LEVELS[1:]:
                if len(query) > DENSE * left.size:  # most are left: all at once is cheaper than one by one
                    left &= ~(lower_distances(q.level(segments)[mine], c.level(segments), squares) - slack > wanted)
                    query, candidate = np.nonzero(left)
                    continue
                keep = []
                for a in range(0, len(query), PAIRS):
                    i, j = query[a : a + PAIRS], candidate[a : a + PAIRS]
                    inner = np.einsum("ij,ij->i", q.level(segments)[mine[i]], c.level(segments)[j])
                    keep.append(~(squares[i, j] - 2 * inner - slack[i, j] > wanted[i, j]))
                keep = np.concatenate(keep) if keep else np.zeros(0, bool)
                query, candidate = query[keep], candidate[keep]
            total += len(query)
            exact = np.sqrt(q.squares[mine].max() * c.squares.max()) < EXACT
            known = (q.vectors[mine] @ c.vectors.T)[query, candidate] if exact and len(query) > DENSE * left.size else None
            self.compared(c, mine[query], candidate, known)
        return total

    def found(self) -> pd.DataFrame:
        q = self.queries
        ids = pd.array(self.ids, dtype="Int64")
        ids[~self.known] = pd.NA
        return pd.DataFrame({"query_row": q.rows[self.query], "query_id": q.ids[self.query], "vec_id": ids, "score": self.score})


def _blocks(batches: Iterable[pd.DataFrame], scale: int) -> Iterator[pd.DataFrame]:
    """Rows of vectors, scaled to whole numbers, as packed blocks; ``asked`` rows once more as blocks of queries."""
    task, number, start = TaskContext.get().partitionId(), 0, 0
    waiting: list[pd.DataFrame] = []

    def block(rows: pd.DataFrame, kind: str) -> dict:
        width = max(map(len, rows["vector"]), default=0)
        vectors = np.zeros((len(rows), width))
        for i, v in enumerate(rows["vector"]):
            vectors[i, : len(v)] = np.floor(np.asarray(v) * float(scale))
        known = rows["id"].notna().to_numpy()
        made = Block(rows["id"].fillna(0).to_numpy(np.int64), known, rows["row"].to_numpy(np.int64), vectors)
        return {"kind": kind, "task": task, "number": number, "data": made.packed()}

    def flush() -> Iterator[pd.DataFrame]:
        nonlocal number
        rows = pd.concat(waiting, ignore_index=True)
        for kind, which, most in (("c", rows, ROWS), ("q", rows[rows["asked"]], QUERY_ROWS)):
            for at in range(0, len(which), most):
                yield pd.DataFrame([block(which[at : at + most], kind)])
                number += 1
        waiting.clear()

    held = 0
    for rows in batches:
        rows["row"] = (task << 40) + start + np.arange(len(rows))
        start += len(rows)
        waiting.append(rows)
        held += len(rows)
        if held >= ROWS * CHUNK:
            yield from flush()
            held = 0
    if held:
        yield from flush()


def top_k(
    rows: DataFrame, asked: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """The ``k`` largest inner products of each row that ``asked`` holds for, with all other rows: query_id, rank, vec_id, score.

    Components count as floor(scale * x). Ties go to the smaller id, a NULL id last; equal rows are rows of their own, so
    a copy of a query is one of its candidates, and a repeated query id has one list for each of its rows. Vectors that are
    NULL or hold NULL or numbers that are not finite take no part; missing components count as zero. Scores beyond a
    long stop at its ends. With fewer than ``k`` candidates all are listed; an empty table gives no rows. A task holds a
    block of queries and some blocks of candidates. Only the id and the vector are read.
    """
    spark, vector = rows.sparkSession, rows[vector_column]
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < float("inf")))
    table = rows.where(sound).select(
        rows[id_column].cast("bigint").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), vector.cast("array<double>").alias("vector")
    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _blocks(batches, scale)

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, best, kept = None, None, {}
        for batch in batches:
            columns = (batch[c] for c in ("query_block", "queries", "candidate_block", "candidates"))
            for query_block, queries, candidate_block, candidates in zip(*columns):
                if query_block != number:
                    if best is not None:
                        yield best.found()
                    number, best = query_block, Best(Block.of(queries), k)
                # The blocks of a chunk come again for each block of queries; their statistics are made once.
                if candidate_block not in kept:
                    if len(kept) >= 2 * CHUNK:
                        kept.pop(next(iter(kept)))
                    kept[candidate_block] = Block.of(candidates)
                best.search(kept[candidate_block])
        if best is not None:
            yield best.found()

    blocks = written(table.mapInPandas(packed, "kind string, task int, number int, data binary"), "search-blocks")
    candidates, queries = blocks.where("kind = 'c'"), blocks.where("kind = 'q'")
    count = candidates.count()
    # Chunks of some blocks, but as many as can be worked on at a time.
    chunks = max(-(-count // CHUNK), min(count, 2 * spark.sparkContext.defaultParallelism), 1)
    name = F.struct("task", "number").cast("string")
    candidates = candidates.select(F.expr(f"CAST((task + number) % {chunks} AS INT)").alias("chunk"), name.alias("candidate_block"), F.col("data").alias("candidates"))
    queries = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        name.alias("query_block"),
        F.col("data").alias("queries"),
    )
    # As many tasks as chunks, however few bytes these are.
    met = queries.repartition(chunks, "chunk").join(candidates.repartition(chunks, "chunk"), "chunk").select("query_block", "queries", "candidate_block", "candidates")
    with batches_of(spark, BATCH):
        best = written(met.mapInPandas(searched, "query_row bigint, query_id bigint, vec_id bigint, score bigint"), "search-best")
    rank = F.expr("row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id ASC NULLS LAST)")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
