"""Exact top-k inner-product search with block-at-a-time pruning.

Rows are put into blocks of near vectors: each goes to its nearest pivot (a
bounded sample of the rows), and rows are sorted by pivot and id. A block keeps
the largest and the smallest value of every dimension (term). For a query the
sum of the terms' largest possible contributions bounds the score of any row of
the block. Blocks are visited from the highest bound down and scored through
their forward index (the block's matrix) until the bounds are below the
query's k-th best score so far, which starts from a bounded set of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from factloom.llm.common import bounded_batches, materialize, query


def quantized(df: DataFrame, vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and q array<long> = floor(scale * x); vectors that are null or hold null or non-finite parts are left out.

    Of rows that share an id each takes part. Other columns are left out.
    """
    v = F.col(vector_col)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return df.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _by_width(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the rows of each width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(pick, column.take(pa.array(pick)).flatten().to_numpy().reshape(len(pick), int(width))) for width in np.unique(sizes) for pick in [np.flatnonzero(sizes == width)]]


_BLOCK = "width int, pivot int, first boolean, ids binary, rows binary, high binary, low binary"


def _nearest(pivots: dict[int, np.ndarray]):
    """Add each row's width and nearest pivot."""

    def run(batches):
        for batch in batches:
            width, near = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for pick, matrix in _by_width(batch.column(1)):
                width[pick] = matrix.shape[1]
                if matrix.shape[1] in pivots:
                    p = pivots[matrix.shape[1]]
                    near[pick] = np.argmax(matrix.astype(np.float64) @ p.T - 0.5 * (p * p).sum(axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(width), pa.array(near)], names=["vec_id", "q", "width", "pivot"])

    return run


def _packed(block_rows: int):
    """Sorted rows to blocks of one width and pivot; a pivot's first block of a partition is marked."""

    def run(batches):
        seen = set()
        for batch in batches:
            ids, pivot = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            out = {name.split()[0]: [] for name in _BLOCK.split(", ")}
            for pick, matrix in _by_width(batch.column(1)):
                matrix = matrix.astype(np.int32) if np.abs(matrix).max(initial=0) < 2**31 else matrix
                place = np.arange(len(pick))
                start = np.flatnonzero(np.append(True, pivot[pick][1:] != pivot[pick][:-1]))
                run_start = np.repeat(start, np.diff(np.append(start, len(pick))))
                for a, b in zip(edges := np.flatnonzero((place - run_start) % block_rows == 0), np.append(edges[1:], len(pick)), strict=True):
                    rows, key = matrix[a:b], (matrix.shape[1], int(pivot[pick[a]]))
                    values = (*key, key not in seen, ids[pick[a:b]].tobytes(), rows.tobytes(), rows.max(axis=0).tobytes(), rows.min(axis=0).tobytes())
                    seen.add(key)
                    for column, value in zip(out.values(), values, strict=True):
                        column.append(value)
            kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


class Search:
    """The k best rows of every query among the blocks seen so far."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, least: np.ndarray, k: int) -> None:
        self.ids, self.asked, self.k = ids, asked, k
        #: A score that k rows of a query reach for sure; rows below it are no answer.
        self.least = least.astype(np.float64)
        self.peak = float(np.abs(asked).max(initial=0)) * max(1, asked.shape[1])
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.seen = self.scored = 0

    def add(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Visit blocks (ids, rows, high, low), those of the highest bound first."""
        high, low = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
        # Doubles hold sums below 2^53 exactly, whole numbers of 64 bits those below 2^63.
        peak = self.peak * max(float(np.abs(high).max(initial=0)), float(np.abs(low).max(initial=0)))
        kind = np.float64 if peak < 2.0**53 else np.int64 if peak < 2.0**62 else object
        asked = self.asked.astype(kind)
        bounds = np.maximum(asked, 0) @ high.astype(kind).T + np.minimum(asked, 0) @ low.astype(kind).T
        self.seen += bounds.size
        for b in np.argsort(-bounds.max(axis=0).astype(np.float64), kind="stable"):
            # Doubles may round large sums down, so the comparison is by less than the bound itself there.
            open_ = np.flatnonzero(bounds[:, b].astype(np.float64) * (1 + 1e-12 * np.sign(bounds[:, b].astype(np.float64))) >= self.least)
            self.scored += len(open_)
            if not len(open_):
                continue
            ids, rows = blocks[b][:2]
            scores = asked[open_] @ rows.astype(kind).T
            a, i = np.nonzero((scores >= self.least[open_][:, None]) & (ids[None, :] != self.ids[open_][:, None]))
            self.found.append((open_[a], ids[i], scores[a, i].astype(np.int64)))
            self.held += len(a)
            if self.held > 4 * self.k * max(len(self.ids), 256):
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and scores of what is best so far; the bounds rise to each query's k-th score."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        asks, ids, scores = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, -scores, asks))
        asks, ids, scores = asks[order], ids[order], scores[order]
        place = np.arange(len(asks)) - np.searchsorted(asks, asks)
        last = place == self.k - 1
        self.least[asks[last]] = np.maximum(self.least[asks[last]], np.nextafter(scores[last].astype(np.float64), -np.inf) if len(scores) and np.abs(scores).max() >= 2**53 else scores[last])
        keep = place < self.k
        self.found = [(asks[keep], ids[keep], scores[keep])]
        self.held = int(keep.sum())
        return self.found[0]


def _searched(shared, k: int):
    """Blocks to the k best rows of each query among a task's blocks."""

    def run(batches):
        searches = {width: Search(ids, asked, least, k) for width, (ids, asked, least) in shared.value.items()}
        for batch in batches:
            blocks: dict[int, list] = {}
            for width, ids, rows, high, low in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)), strict=True):
                if width in searches:
                    number = np.frombuffer(ids, np.int64)
                    kind = np.int32 if len(rows) == 4 * len(number) * width else np.int64
                    blocks.setdefault(width, []).append((number, np.frombuffer(rows, kind).reshape(-1, width), np.frombuffer(high, kind), np.frombuffer(low, kind)))
            for width, own in blocks.items():
                searches[width].add(own)
        for search in searches.values():
            asks, ids, scores = search.best()
            yield pa.RecordBatch.from_arrays([pa.array(search.ids[asks]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 256, block_rows: int = 64, query_rows: int = 1 << 15) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank, vec_id, score.

    vectors and queries: vec_id long, q array<long>. A row is no candidate for
    a query with its own id. Ties go to the smaller id; fewer than k candidates
    are all returned. Rows of another length than the query's take no part in
    that query's result. Queries must have distinct ids; rows may repeat. A
    score beyond 64 bits is an error. Empty inputs give no rows.

    The rows are shuffled once, into blocks that are written. The queries go to
    the blocks as a broadcast of at most query_rows queries; more are searched in
    several passes over the blocks. A first pass over one block a pivot
    and partition gives each query a score that its answers reach, so few rows leave
    the tasks of the second. Pivots are a sample of at most `pivots` rows, the
    first by hash; every row is indexed, and the result is exact whatever they are.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    sample = {}
    for (q,) in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("q").collect():
        sample.setdefault(len(q), []).append(q)
    near = vectors.select("vec_id", "q").mapInArrow(_nearest({w: np.array(x, np.float64) for w, x in sample.items()}), "vec_id long, q array<long>, width int, pivot int")
    order = ("width", "pivot", "vec_id")
    blocks = materialize(near.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed(block_rows), _BLOCK), "blocks")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(part: DataFrame, asks: dict) -> DataFrame:
        found = part.mapInArrow(_searched(spark.sparkContext.broadcast(asks), k), "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    out = None
    passes = max(1, -(-queries.count() // query_rows))
    for i in range(passes):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).select("vec_id", "q").toArrow()
        asks = {m.shape[1]: (own["vec_id"].to_numpy()[pick], m, np.full(len(pick), -np.inf)) for pick, m in _by_width(own["q"])} if own.num_rows else {}
        # The seeds: at most one score a query comes to the driver.
        least = {r[0]: r[1] for r in searched(blocks.where("first"), asks).where(F.col("rank") == k).select("query_id", "score").collect()} if asks else {}
        for width, (ids, asked, _) in asks.items():
            asks[width] = (ids, asked, np.nextafter(np.array([least.get(x, -np.inf) for x in ids.tolist()], np.float64), -np.inf))
        found = searched(blocks, asks)
        out = found if out is None else out.unionByName(found)
    return out


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op3_block_max_top_k", OP3_SQL)
def op3_block_max_top_k(spark, sf_dir):
    """Top 10 of all embeddings for every vector whose id is divisible by 100."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))
