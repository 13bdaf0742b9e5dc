"""Nearest neighbours by a block matrix join of int8 tiles with error bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.common import stored

#: Vectors of a tile: so many queries by so many candidates, fewer where they are wide.
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 8192
#: Bytes of the vectors of either side of a tile, at most (one vector at least).
BLOCK_BYTES = 16 << 20
#: Components whose int8 products a float32 sums exactly: 1024 * 127 * 127 is below 2**24.
EXACT_WIDTH = 1024
#: Lists of a query that one merge takes.
MERGE = 512


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row, and the norms of what is kept and of what is lost."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = np.finfo(float).tiny
    q = np.rint(x / scale[:, None]).astype(np.int8)
    kept = q * scale[:, None]
    return q, scale, np.sqrt((kept**2).sum(1)), np.sqrt(((x - kept) ** 2).sum(1))


def whole_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y of whole numbers from -127 to 127, exactly: float32 products over stretches that float32 holds, summed in double."""
    out = (x[:, :EXACT_WIDTH] @ y[:EXACT_WIDTH]).astype(np.float64)
    for at in range(EXACT_WIDTH, x.shape[1], EXACT_WIDTH):
        out += x[:, at : at + EXACT_WIDTH] @ y[at : at + EXACT_WIDTH]
    return out


def exact_scores(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of the named pairs in double precision, summed from the first component to the last."""
    out = np.zeros(len(row))
    for at in range(0, len(row), 1 << 15):
        a, b = queries[row[at : at + (1 << 15)]], vectors[col[at : at + (1 << 15)]]
        for i in range(a.shape[1]):
            out[at : at + len(a)] += a[:, i] * b[:, i]
    return out


def tile_nearest(query_ids: np.ndarray, queries: np.ndarray, ids: list[list[int]], vectors: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k best of the tile: (-score, vec_id), best first, ties to the smaller id.

    vectors are distinct; ids holds those of each, ascending, k + 1 at most. x.y differs from the product of the int8
    vectors by at most |x kept| |y lost| + |x lost| |y|. What could reach the k-th largest lower bound survives and
    is computed again from the vectors themselves.
    """
    qq, qs, qk, ql = quantised(queries)
    cq, cs, _, cl = quantised(vectors)
    norm = np.sqrt((vectors**2).sum(1))
    codes = cq.astype(np.float32).T
    alone = {i[0]: n for n, i in enumerate(ids) if len(i) == 1}  # vectors that only one row has
    for at in range(0, len(queries), 128):
        near = whole_products(qq[at : at + 128].astype(np.float32), codes) * qs[at : at + 128, None] * cs
        error = (qk[at : at + 128, None] * cl + ql[at : at + 128, None] * norm + np.abs(near)) * 1e-9 + 1e-300
        error += qk[at : at + 128, None] * cl + ql[at : at + 128, None] * norm
        low, high = near - error, near + error
        for i, q in enumerate(query_ids[at : at + 128].tolist()):
            if q in alone:
                low[i, alone[q]] = high[i, alone[q]] = -np.inf
        bar = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        row, col = np.nonzero((high >= bar[:, None]) & (high > -np.inf))
        score = exact_scores(queries[at : at + 128], vectors, row, col)
        ends = np.searchsorted(row, np.arange(len(low) + 1))
        for i, q in enumerate(query_ids[at : at + 128].tolist()):
            found = zip((-score[ends[i] : ends[i + 1]]).tolist(), col[ends[i] : ends[i + 1]].tolist(), strict=True)
            yield q, heapq.nsmallest(k, ((s, n) for s, c in found for n in ids[c] if n != q))


def _tile(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids_of, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            same: dict[bytes, set[int]] = {}
            for v, i in zip(right.column("c_v").to_pylist(), right.column("c_id").to_pylist(), strict=True):
                same.setdefault(v, set()).add(i)
            matrix = lambda values: np.stack([np.frombuffer(x, np.float64) for x in values])
            ids = [heapq.nsmallest(k + 1, i) for i in same.values()]
            for query, best in tile_nearest(left.column("q_id").to_numpy(), matrix(left.column("q_v").to_pylist()), ids, matrix(same), k):
                ids_of += [query] * len(best)
                found += [i for _, i in best]
                scores += [-s for s, _ in best]
        block = pa.array([key[1].as_py()] * len(found), pa.int64())
        return pa.table({"query_id": pa.array(ids_of, pa.int64()), "part": block, "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    return run


def _merge(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        best = heapq.nsmallest(k, set(zip((-table.column("score").to_numpy()).tolist(), table.column("vec_id").to_pylist(), strict=True)))
        return pa.table({
            "query_id": pa.array([key[0].as_py()] * len(best), pa.int64()), "part": pa.array([key[1].as_py()] * len(best), pa.int64()), "rank": pa.array(range(1, len(best) + 1), pa.int32()),
            "vec_id": pa.array([i for _, i in best], pa.int64()), "score": pa.array([-s for s, _ in best], pa.float64()),
        })

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of double precision."""
    for batch in batches:
        lists = batch.column("x")
        size = pc.list_value_length(lists).to_numpy().astype(np.int64) * 8
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        out = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), out.cast(pa.binary())], ["vec_id", "v"])


def nearest_neighbours(embeddings: DataFrame, k: int = 20, every: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`, candidates every row of another vec_id. Queries and
    candidates are dealt into blocks by hash; each pair of blocks is a tile, one task's work of bounded size, and gives
    k rows per query. Heaps merge MERGE tiles' rows of a query at a time. Nothing is approximate in the result: the
    int8 bounds, which hold for vectors of any width, only spare exact products.

    Vectors that are null, empty or zero, or hold null or non-finite components, take no part; neither does
    a null vec_id. Rows that repeat a vec_id with the same score count once; the query's own vec_id never
    counts. Rows that repeat a query's vec_id with another vector ask too: the query's one list holds the best scores that any
    of them gives, a vec_id once for each of its scores. Vectors of another length than a query's are not its
    candidates. Other columns are not read. An empty table gives no rows.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    read = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & sound)
    packed = stored(read.mapInArrow(_packed, "vec_id long, v binary"), "ann-vectors").withColumn("width", F.octet_length("v"))
    total, queries, widest = packed.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.coalesce(F.max("width"), F.lit(8))).first()
    fit = max(1, BLOCK_BYTES // widest)
    across, down = max(1, -(-total // min(candidate_block, fit))), max(1, -(-queries // min(query_block, fit)))
    place = F.xxhash64("vec_id", "v")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = packed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    left = asked.select(F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.col("width").alias("q_w"), F.pmod(place, F.lit(down)).alias("q_q"), upto(across).alias("q_c"))
    right = packed.select(F.col("vec_id").alias("c_id"), F.col("v").alias("c_v"), F.col("width").alias("c_w"), F.pmod(place, F.lit(across)).alias("c_c"), upto(down).alias("c_q"))
    lists = left.groupBy("q_q", "q_c", "q_w").cogroup(right.groupBy("c_q", "c_c", "c_w")).applyInArrow(_tile(k), "query_id long, part long, vec_id long, score double")
    while True:
        across = -(-across // MERGE)
        part = F.pmod("part", F.lit(across)).alias("part")
        lists = lists.select("query_id", part, "vec_id", "score").groupBy("query_id", "part").applyInArrow(_merge(k), "query_id long, part long, rank int, vec_id long, score double")
        if across == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
