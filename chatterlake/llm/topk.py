"""Exact top-k search by distributed histogram selection.

Queries and candidates meet in a grid of blocks: query block x candidate slot, so a stated
query set is scored against all rows with each side copied only along one edge of the grid.
Every pass scores everything again and sends back little. The first passes refine, for
each query, a global histogram of scores: the bin that holds the k-th highest score is cut
into `BINS` finer ones, until it is one score wide. A block only sends its bins from the
top down to its own k-th score, which the global k-th can't lie below. The last pass
filters by the k-th score; a block sends its k best at most, ties by the smaller id.

Scores are integer inner products of floor(256 * x). They are computed in doubles where
that is exact, else in Python's integers. Scores beyond +-`MOST` count as that, so every
finite vector takes part; floors beyond +-1e300 count as that.

Defined cases. A null vector, or one with a null or non-finite component, takes no part,
nor does a row without an id. Vectors of another length than the query score over the
components that both have; an empty one scores 0. Rows that repeat an id are candidates
each, so an id may be listed more than once; a query's own rows are all rows with its id,
and if it has several vectors, the k best scores of all of them count. Rows alike in score
and id take any order among themselves. Fewer candidates than k: all of them. No queries
or no rows: an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

K, SCALE, BINS = 5, 256, 1024
#: Rows of a query block and of a candidate slot.
QUERIES, CANDIDATES = 1024, 4096
#: Slots at least, so that small tables spread as well.
LEAST_SLOTS = 48
#: Products below 2^53 are exact in doubles.
EXACT = 2.0**53
#: The largest score; a score that is never reached is below the least.
MOST = (1 << 62) - 1
NEVER = -(1 << 62)


def quantized(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, SCALE times each component, and a number of the row; only vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    # Multiplying by a power of two is exact; only the largest doubles would leave their range.
    rows = rows.filter("vec_id is not null").filter(good)
    return rows.select("vec_id", F.transform("v", lambda x: F.greatest(F.lit(-1e300), F.least(x * float(SCALE), F.lit(1e300)))).alias("v"), F.monotonically_increasing_id().alias("row"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Floored rows, zeros after a short vector's end."""
    offsets = lists.offsets.to_numpy()
    flat = np.floor(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
    size = np.diff(offsets)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out



def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products (queries x candidates), at most MOST either way."""
    with np.errstate(over="ignore"):
        high = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if high < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.maximum(np.minimum(whole(a) @ whole(b).T, MOST), -MOST).astype(np.int64)


def block(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, all scores, which pairs count, and each query's k-th score here (or the least)."""
    u, v = left["v"].combine_chunks(), right["u"].combine_chunks()
    width = max(int(np.diff(x.offsets.to_numpy()).max(initial=0)) for x in (u, v))
    a, b = left["vec_id"].to_numpy(), right["name"].to_numpy()
    score = scores(matrix(u, width), matrix(v, width))
    other = a[:, None] != b[None, :]
    masked = np.where(other, score, NEVER)
    kth = np.partition(masked, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(a), NEVER)
    return a, b, score, other, kth


def top_k(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best. is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(quantized(vectors, id_col, vector_col))
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("high"), F.max(F.size("v")).alias("width")).first()
    if not size["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-size["q"] // QUERIES)
    slots = max(LEAST_SLOTS, -(-size["n"] // CANDIDATES))
    reach = int(min((min(size["high"] or 0.0, 1e100) + 1) ** 2 * max(1, size["width"]), float(MOST // 2))) + 1
    if reach > MOST // 2:
        reach = MOST
    # Rows are spread by their own numbers: an id that many rows share is in all slots.
    spread = F.xxhash64("row", F.lit(5))
    queries = rows.filter(is_query).withColumn("b", F.pmod(spread, F.lit(blocks)).cast("int"))
    right = rows.select(F.col("vec_id").alias("name"), F.col("v").alias("u"), F.pmod(spread, F.lit(slots)).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("c"))

    def meet(state: DataFrame, work, schema: str) -> DataFrame:
        left = queries.join(state, "vec_id").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        return left.groupBy("b", "s").cogroup(right.groupBy("c", "t")).applyInArrow(work, schema)

    def histogram(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, _, score, other, kth = block(a, b, k)
        low, wide = a["low"].to_numpy()[:, None], a["wide"].to_numpy()[:, None]
        least = np.maximum(low, (kth[:, None] - low) // wide * wide + low)  # the bin of the k-th score here, and above
        q, c = np.nonzero(other & (score >= least))
        bins = np.minimum((score[q, c] - low[q, 0]) // wide[q, 0], BINS)  # what is above the range is known to be in
        both, n = np.unique(q * (BINS + 1) + bins, return_counts=True)
        return pa.table({"vec_id": ids[both // (BINS + 1)], "bin": both % (BINS + 1), "n": n.astype(np.int64)})

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, names, score, other, kth = block(a, b, k)
        q, c = np.nonzero(other & (score >= np.maximum(a["low"].to_numpy(), kth)[:, None]))
        order = np.lexsort((names[c], -score[q, c], q))
        q, c = q[order], c[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, c = q[first], c[first]
        return pa.table({"query_id": ids[q], "vec_id": names[c], "score": score[q, c]})

    # [low, low + BINS * wide) holds the k-th score of each query.
    wide = -(-(2 * reach + 1) // BINS)
    state = queries.select("vec_id").distinct().select("vec_id", F.lit(-reach).cast("long").alias("low"), F.lit(wide).cast("long").alias("wide"))
    while wide:
        counts = meet(state, histogram, "vec_id long, bin long, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        ranked = counts.withColumn("above", F.sum("n").over(Window.partitionBy("vec_id").orderBy(F.desc("bin"))))
        kth = ranked.groupBy("vec_id").agg(F.max(F.when(F.col("above") >= k, F.col("bin"))).alias("bin"))
        wide = -(-wide // BINS) if wide > 1 else 0
        cut = F.coalesce(F.col("low") + F.col("bin") * F.col("wide"), F.col("low"))  # fewer than k in all: every score is in
        state = scratch.write(state.join(kth, "vec_id", "left").select("vec_id", cut.alias("low"), F.lit(wide).cast("long").alias("wide")))
    picked = meet(state, best, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
