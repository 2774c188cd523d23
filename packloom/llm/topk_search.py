"""Exact top-k by integer inner product: every query against every candidate, by histograms.

Vectors are rounded to integers and packed into blocks of one dimension and number type.
Query blocks and candidate blocks meet in *cells* of a fixed number of blocks (a merge join
on the cell, asked for: each side is copied for its cells, which Spark's estimate of its size
leaves out, so it would be broadcast), and all scores of a pair of blocks are one matrix
product. No score is ever written. Each round counts, per query, the scores that fall into
the bins of the range where its k-th value must lie; the counts are summed over the whole
corpus and the range shrinks to the bin that holds the k-th value. When every query's bin
holds just the wanted scores, or is one value wide, a last pass keeps what lies above the
edge, and of the scores on it as many as are wanted, by id.

A block never reports bins below its own k-th score: the k-th value of all cannot lie there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

SCALE = 256.0
BINS = 4096  # of one round; a range of 2 ** 63 takes six rounds
QUERY_ROWS, CANDIDATE_ROWS = 1024, 2048  # rows of a block at most
QUERY_BLOCKS, CANDIDATE_BLOCKS = 256, 64  # blocks of a cell at most, on average
EXACT = 1 << 53  # products below are exact as doubles
LIMIT = (1 << 62) - 1  # scores beyond are given as the limit

BLOCK = "dim int, kind string, n int, top double, ids binary, vectors binary"
NUMBERS = {"i2": np.int16, "i4": np.int32, "f8": np.float64}


def finite(vector: Column) -> Column:
    """Whether a vector takes part: not NULL, no component NULL, NaN or infinite, also not after scaling."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, good), F.lit(False))


def _pack(scale: float, rows: int):
    """Rows (id, vector) to blocks of one dimension and number type, in id order."""

    def block(dim: int, kind: str, ids: list[np.ndarray], vectors: list[np.ndarray]) -> dict:
        at, values = np.concatenate(ids), np.concatenate(vectors)
        order = np.argsort(at, kind="stable")
        top = float(np.abs(values).max()) if values.size else 0.0
        return {"dim": dim, "kind": kind, "n": len(at), "top": top, "ids": at[order].tobytes(), "vectors": values[order].astype(NUMBERS[kind]).tobytes()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("kind", pa.string()), ("n", pa.int32()), ("top", pa.float64()), ("ids", pa.binary()), ("vectors", pa.binary())])
        open_blocks: dict[tuple[int, str], tuple[list, list]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
            dims = np.diff(offsets)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                vectors = flat[offsets[mine][:, None] + np.arange(dim)]
                tops = np.abs(vectors).max(axis=1) if dim else np.zeros(len(mine))
                for kind, low, high in (("i2", -1.0, 2.0**15), ("i4", 2.0**15, 2.0**31), ("f8", 2.0**31, np.inf)):
                    fits = (tops >= low) & (tops < high)
                    if not fits.any():
                        continue
                    key = (int(dim), kind)
                    held = open_blocks.setdefault(key, ([], []))
                    held[0].append(ids[mine][fits])
                    held[1].append(vectors[fits])
                    while sum(map(len, held[0])) >= rows:
                        at, values = np.concatenate(held[0]), np.concatenate(held[1])
                        yield pa.RecordBatch.from_pylist([block(*key, [at[:rows]], [values[:rows]])], schema)
                        held[0][:], held[1][:] = [at[rows:]], [values[rows:]]
        for key, held in open_blocks.items():
            if sum(map(len, held[0])):
                yield pa.RecordBatch.from_pylist([block(*key, *held)], schema)

    return pack


def blocks(df: DataFrame, id: str, vector: str, scale: float, rows: int, name: str) -> DataFrame:
    """The rows that take part as blocks, numbered, written to the shared folder."""
    rows_in = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & finite(F.col("vector")))
    parts = max(1, -(-df.count() // rows))
    packed = rows_in.repartition(parts).mapInArrow(_pack(scale, rows), BLOCK)
    return staged(packed.withColumns({"block": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), name)


def scores(q: np.ndarray, c: np.ndarray, q_top: float, c_top: float) -> np.ndarray:
    """All inner products as 64-bit integers, clipped to the limit; every path is exact."""
    dim = q.shape[1]
    bound = int(q_top) * int(c_top) * dim
    if bound < EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound <= LIMIT:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    exact = whole(q) @ whole(c).T
    return np.array([[max(-LIMIT, min(LIMIT, int(v))) for v in row] for row in exact], dtype=np.int64).reshape(len(q), len(c))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per pair of blocks: query block, rows of the block, their ids, edges, spans and wants, candidate ids, scores."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            dim = one["dim"]
            take = np.array(one["rows"], dtype=np.int64)
            ids = np.frombuffer(one["q_ids"], dtype=np.int64)[take]
            q = np.frombuffer(one["q_vectors"], dtype=NUMBERS[one["q_kind"]]).reshape(-1, dim)[take] if dim else np.zeros((len(take), 0))
            at = np.frombuffer(one["c_ids"], dtype=np.int64)
            c = np.frombuffer(one["c_vectors"], dtype=NUMBERS[one["c_kind"]]).reshape(-1, dim) if dim else np.zeros((len(at), 0))
            edge, span, want = (np.array(one[x], dtype=np.int64) for x in ("edges", "spans", "wants"))
            yield one["q_block"], take, ids, edge, span, want, at, scores(q, c, one["q_top"], one["c_top"])


def _widths(span: np.ndarray, bins: int) -> np.ndarray:
    """Width of the equal bins that cover a range of ``span`` values."""
    return (span - 1) // bins + 1


def _histogram(k: int, bins: int):
    schema = pa.schema([("q_block", pa.int64()), ("row", pa.int32()), ("bin", pa.int32()), ("found", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, take, ids, edge, span, _, at, score in _pairs(batches):
            # Within 2 ** 63 of the edge, so unsigned differences are exact.
            off = score.astype(np.uint64) - edge[:, None].astype(np.uint64)
            outside = (score < edge[:, None]) | (off >= span[:, None].astype(np.uint64)) | (at[None, :] == ids[:, None])
            place = (off // _widths(span, bins)[:, None].astype(np.uint64)).astype(np.int64)
            place[outside] = -1
            if len(at) > k:
                place[place < np.partition(place, len(at) - k, axis=1)[:, [len(at) - k]]] = -1
            rows, columns = np.nonzero(place >= 0)
            cell, found = np.unique(rows * bins + place[rows, columns], return_counts=True)
            if len(cell):
                row = take[cell // bins].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), block)), pa.array(row), pa.array((cell % bins).astype(np.int32)), pa.array(found.astype(np.int64))], schema=schema)

    return count


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores above each query's edge, and on it the wanted number of smallest ids of the block."""
    schema = pa.schema([("q_block", pa.int64()), ("row", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    for block, take, ids, edge, _span, want, at, score in _pairs(batches):
        other = at[None, :] != ids[:, None]
        on = (score == edge[:, None]) & other
        keep = ((score > edge[:, None]) & other) | (on & (np.cumsum(on, axis=1) <= want[:, None]))
        rows, columns = np.nonzero(keep)
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), block)), pa.array(take[rows].astype(np.int32)), pa.array(ids[rows]), pa.array(at[columns]), pa.array(score[rows, columns])], schema=schema
            )


def _meet(q_blocks: DataFrame, c_blocks: DataFrame, state: DataFrame, cells: tuple[int, int]) -> DataFrame:
    """Pairs of blocks with the ranges of the queries in ``state``; a pair meets in one cell."""
    down, across = cells
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lists = F.array_sort(F.collect_list(F.struct("row", "edge", "span", "want"))).alias("l")
    ranges = state.groupBy("q_block").agg(lists)
    ranges = ranges.select(F.col("q_block").alias("block"), F.col("l.row").alias("rows"), F.col("l.edge").alias("edges"), F.col("l.span").alias("spans"), F.col("l.want").alias("wants"))
    q = q_blocks.join(ranges, "block").select(
        "dim", number(down).alias("down"), F.pmod("part", F.lit(across)).alias("across"), F.col("block").alias("q_block"), "rows", "edges", "spans", "wants",
        F.col("kind").alias("q_kind"), F.col("top").alias("q_top"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
    )
    c = c_blocks.select(
        "dim", F.pmod("part", F.lit(down)).alias("down"), number(across).alias("across"),
        F.col("kind").alias("c_kind"), F.col("top").alias("c_top"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"),
    )
    return q.join(c.hint("merge"), ["dim", "down", "across"])


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = SCALE, bins: int = BINS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query, or all if fewer.

    A component x counts as floor(scale * x), x as double; the score is the inner product of
    the integers, clipped to +-(2 ** 62 - 1). Equal scores go to the smaller id. A query's own row
    is no candidate: rows with its id. Vectors that are NULL or hold a NULL, NaN or infinite
    component, and rows with a NULL id, take no part. Vectors of different length have no
    score, empty ones score 0. Every row of a repeated id is a query and a candidate of its
    own. Other columns are not looked at. Empty tables give no rows.
    """
    spark = candidates.sparkSession
    q_blocks = blocks(queries, id, vector, scale, QUERY_ROWS, "query-blocks")
    c_blocks = blocks(candidates, id, vector, scale, CANDIDATE_ROWS, "candidate-blocks")
    many = lambda df: (df.agg(F.max("part")).first()[0] or 0) + 1
    n_q, n_c = many(q_blocks), many(c_blocks)
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = (min(n_c, max(tasks, -(-n_c // CANDIDATE_BLOCKS))), -(-n_q // QUERY_BLOCKS))

    # No score of a query lies beyond the product of the largest components.
    tops = c_blocks.groupBy("dim").agg(F.max("top").alias("c_top"))
    product = F.col("dim") * F.col("top") * F.col("c_top") * (1 + 1e-9)
    bound = F.when(product >= float(LIMIT // 2), F.lit(LIMIT)).otherwise(F.ceil(product).cast("bigint"))
    first = q_blocks.join(tops, "dim").select(
        F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"), (-bound).alias("edge"),
        (bound * 2 + 1).alias("span"), F.lit(k).cast("bigint").alias("want"), F.lit(True).alias("open"),
    )
    state = staged(first, "ranges")
    by_query = Window.partitionBy("q_block", "row").orderBy(F.col("bin").desc())
    while not state.where("open").isEmpty():
        counts = _meet(q_blocks, c_blocks, state.where("open"), cells).mapInArrow(_histogram(k, bins), "q_block bigint, row int, bin int, found bigint")
        summed = counts.groupBy("q_block", "row", "bin").agg(F.sum("found").alias("found"))
        reached = summed.withColumn("sofar", F.sum("found").over(by_query)).join(state.where("open"), ["q_block", "row"])
        kth = reached.where((F.col("sofar") >= F.col("want")) & (F.col("sofar") - F.col("found") < F.col("want")))
        kth = kth.select("q_block", "row", "bin", "found", (F.col("want") - F.col("sofar") + F.col("found")).alias("left"))
        width = F.expr(f"(span - 1) div {bins} + 1")
        # Without a k-th value there are fewer than k candidates: all that lies above the range's edge is taken.
        settled = state.join(kth, ["q_block", "row"], "left").select(
            "q_block",
            "row",
            F.when(F.col("bin").isNull(), F.col("edge")).otherwise(F.col("edge") + F.col("bin") * width).alias("edge"),
            F.when(F.col("bin").isNull(), F.col("span")).otherwise(width).alias("span"),
            F.coalesce("left", "want").alias("want"),
            F.coalesce((width > 1) & (F.col("found") > F.col("left")), F.lit(False)).alias("open"),
        )
        state = staged(settled, "ranges")
    kept = _meet(q_blocks, c_blocks, state, cells).mapInArrow(_keep, "q_block bigint, row int, query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("q_block", "row").orderBy(F.col("score").desc(), "vec_id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""
