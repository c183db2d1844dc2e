"""Exact top-k by inner product with a pivot table.

Every vector's distances to the pivots are computed once. By the triangle
inequality the distance of a query q and a vector x is at least
max over pivots p of |d(q, p) - d(x, p)|, which bounds their inner product
(|q|^2 + |x|^2 - d^2) / 2 from above. Queries and vectors are dealt in blocks;
for each query a block's vectors are evaluated in the order of their bounds
until no bound left reaches the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

PIVOTS = 24
#: Vectors from which the pivots are picked, those with the smallest hash of vec_id.
PIVOT_SAMPLE = 2000
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Vectors of a block evaluated at a time.
STEP = 128
SCALE = 1024


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): components as floor(1024 * x), rows without a vector or with null or non-finite components left out."""
    x = F.col(column)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long"))
    return vectors.where(fine).select("vec_id", v.alias("v")).where("vec_id IS NOT NULL")


def _matrix(lists, width: int | None = None) -> np.ndarray:
    """Rows of equal width; shorter vectors end in zeros, which leave inner products as they are."""
    rows = [np.asarray(x, np.int64) for x in lists]
    width = max([width or 0, *(len(r) for r in rows)]) if width is None else width
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of the rows of a and b; in floating point where every sum stays below 2 ** 53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def pick_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Rows far from each other: the first, then each time the row farthest from those picked."""
    if not len(sample):
        return sample
    x = sample.astype(np.float64)
    picked, far = [0], np.full(len(x), np.inf)
    for _ in range(min(n, len(x)) - 1):
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
        picked.append(int(far.argmax()))
    return sample[picked]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    p = pivots.astype(np.float64)
    y = x.astype(np.float64)
    return np.sqrt(np.maximum((y**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * y @ p.T, 0))


def search_block(ids: np.ndarray, x: np.ndarray, dx: np.ndarray, qids: np.ndarray, q: np.ndarray, dq: np.ndarray, k: int) -> tuple[pd.DataFrame, int]:
    """Each query's k best vectors of a block, and how many products that took."""
    nx, nq = (x.astype(np.float64) ** 2).sum(1), (q.astype(np.float64) ** 2).sum(1)
    slack = 1e-6 * (nx.max(initial=0) + nq.max(initial=0)) + 1e-3  # above all rounding of distances
    out, products = [], 0
    for i in range(len(q)):
        gap = np.abs(dx - dq[i]).max(1)
        bound = (nq[i] + nx - gap**2) / 2 + slack
        order = np.argsort(-bound, kind="stable")
        order = order[ids[order] != qids[i]]
        best_s, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            if len(best_s) >= k and bound[some[0]] < best_s[k - 1]:
                break  # no bound left reaches the k-th best
            products += len(some)
            s = np.concatenate([best_s, _exact(q[i : i + 1], x[some])[0]])
            v = np.concatenate([best_id, ids[some]])
            top = np.lexsort((v, -s))[:k]
            best_s, best_id = s[top], v[top]
        out.append(pd.DataFrame({"query_id": qids[i], "vec_id": best_id, "score": best_s}))
    return (pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})), products


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors with the highest integer inner product for every row whose vec_id is divisible by ``every``.

    The query's own vec_id is no candidate; ties go to the smaller vec_id; with
    fewer candidates all are returned. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part. Rows that repeat
    a vec_id are each a candidate; of those that are queries the smallest vector asks. A shorter vector counts as ending in zeros.
    Scaled components beyond 64 bits stop at the ends of a long, and sums of products beyond 64 bits wrap. Other
    columns are not read; an empty table gives an empty one.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = materialize(usable(vectors.select("vec_id", column), column), "vectors")
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toPandas()
    pivots = pick_pivots(_matrix(sample["v"]))
    width = pivots.shape[1] if len(pivots) else 0

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["v"])
            w = max(x.shape[1], width)
            x = np.pad(x, ((0, 0), (0, w - x.shape[1])))
            p = np.pad(pivots, ((0, 0), (0, w - width)))
            b["d"] = list(_distances(x, p))
            yield b

    held = materialize(rows.mapInPandas(table, f"vec_id {kind}, v array<bigint>, d array<double>"), "pivot-table")
    blocks = max(1, -(-n // BLOCK_ROWS))
    queries = held.where(F.col("vec_id") % every == 0)
    q_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    block = lambda x, m: F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)).alias(x)
    left = held.select("*", block("block", blocks), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("q_block"))
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("v", "d")).alias("_m")).select("vec_id", "_m.v", "_m.d")
    right = queries.select("*", block("q_block", q_blocks), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        w = max(max(map(len, x["v"])), max(map(len, q["v"])))
        found, _ = search_block(x["vec_id"].to_numpy(), _matrix(x["v"], w), np.stack(x["d"]), q["vec_id"].to_numpy(), _matrix(q["v"], w), np.stack(q["d"]), k)
        return found

    pair = left.groupBy("block", "q_block").cogroup(right.groupBy("block", "q_block"))
    found = pair.applyInPandas(search, f"query_id {kind}, vec_id {kind}, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")
