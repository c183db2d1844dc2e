"""Exact k-means whose distance bounds are loosened by the norm of a centroid's total displacement (ns-bounds).

Every vector keeps, for each centroid, the distance at which it was last evaluated
and the round of that evaluation. The history of the centroids is kept as well, so
the bound of today is that distance, less (or, for the vector's own centroid, plus)
how far the centroid lies from where it was in that round: the norm of its total
displacement, which is never more than the sum of its drifts round by round. A
centroid whose lower bound does not pass the upper bound is evaluated again, exactly,
in integers; all others are not looked at.

Vectors stay where they are: a round is one pass over the table of vectors with their
bounds, written to the shared folder. Its tasks also add up their clusters, so only
k sums per task meet in a shuffle, and the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, remove_table

SCALE = 256
#: Scaled components stop here, so that a squared distance of 64 components fits a long.
LIMIT = 1 << 27
#: Vector-centroid pairs evaluated at once; bounds temporary arrays to some 30 MB.
PAIRS_AT_ONCE = 1 << 15
#: Share by which bounds are widened, above all rounding of square roots, sums and 32-bit storage.
SLACK = 1e-6
#: Stands for a null vec_id inside, so that ids stay whole numbers in tasks.
_NULL_ID = (1 << 63) - 1
_STATE = "vec_id long, v binary, cluster int, upper double, upper_round short, lower binary, lower_round binary, sums array<long>"


def kept_vectors(vectors: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with exactly ``width`` components, none null or non-finite, each scaled to an integer."""
    x = F.col(column)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(SCALE) * c.cast("double")).cast("long"))).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) == width) & fine).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NULL_ID)).alias("vec_id"), v.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose sha256 of ``seed:vec_id`` come first; rows without vec_id come last, equal ids by their vectors."""
    order = [F.col("vec_id") == _NULL_ID, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256), F.col("v")]
    rows = kept.orderBy(*order).limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x and c, pair by pair, in integers."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), PAIRS_AT_ONCE):
        d = x[at : at + PAIRS_AT_ONCE].astype(np.int64) - c[at : at + PAIRS_AT_ONCE]
        out[at : at + PAIRS_AT_ONCE] = np.einsum("ij,ij->i", d, d)
    return out


class Bounds:
    """What vectors know of their distances: ``cluster``, ``upper`` with its round, ``lower`` for each centroid with its rounds."""

    def __init__(self, n: int, k: int):
        self.cluster = np.zeros(n, np.int32)
        self.upper, self.upper_round = np.full(n, np.inf), np.zeros(n, np.int16)
        self.lower, self.lower_round = np.zeros((n, k), np.float32), np.zeros((n, k), np.uint8)


def assign(x: np.ndarray, b: Bounds, history: list[np.ndarray], first: bool) -> int:
    """Move every vector to its nearest centroid of the last round of ``history`` (ties: smaller number); returns how many distances that took."""
    now, c = len(history) - 1, history[-1]
    k = len(c)
    if first:
        fails = np.ones((len(x), k), bool)
        best = np.full(len(x), np.iinfo(np.int64).max)
        taken = 0
    else:
        # Total displacement of each centroid since each round; rounding up keeps the bounds true.
        moved = np.array([np.sqrt(((c - h).astype(np.float64) ** 2).sum(1)) for h in history]) * (1 + SLACK)
        lower = b.lower * (1 - SLACK) - moved[b.lower_round, np.arange(k)]
        rows = np.arange(len(x))
        upper = (b.upper + moved[b.upper_round, b.cluster]) * (1 + SLACK)
        lower[rows, b.cluster] = np.inf
        loose = np.flatnonzero((lower <= upper[:, None]).any(1))
        best = np.zeros(len(x), np.int64)
        best[loose] = squared(x[loose], c[b.cluster[loose]])  # the own centroid first: it often settles the rest
        b.upper[loose], b.upper_round[loose] = np.sqrt(best[loose].astype(np.float64)), now
        upper[loose] = b.upper[loose] * (1 + SLACK)
        fails = np.zeros((len(x), k), bool)
        fails[loose] = lower[loose] <= upper[loose, None]
        b.lower[loose, b.cluster[loose]], b.lower_round[loose, b.cluster[loose]] = b.upper[loose], now
        taken = len(loose)
    for j in range(k):
        i = np.flatnonzero(fails[:, j])
        if not len(i):
            continue
        d = squared(x[i], np.broadcast_to(c[j], (len(i), c.shape[1])))
        taken += len(i)
        b.lower[i, j], b.lower_round[i, j] = np.sqrt(d.astype(np.float64)), now
        better = (d < best[i]) | ((d == best[i]) & (j < b.cluster[i]))
        to = i[better]
        best[to], b.cluster[to] = d[better], j
        b.upper[to], b.upper_round[to] = np.sqrt(d[better].astype(np.float64)), now
    return taken


def _halves(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """(k, 1 + width): members of each cluster and the sums of their components."""
    out = np.zeros((k, 1 + x.shape[1]), np.int64)
    order = np.argsort(cluster, kind="stable")
    edge = np.searchsorted(cluster[order], np.arange(k + 1))
    for j in np.flatnonzero(np.diff(edge)):
        mine = x[order[edge[j] : edge[j + 1]]]
        out[j, 0], out[j, 1:] = len(mine), mine.sum(0, dtype=np.int64)
    return out


def _pass(history: list[np.ndarray], width: int):
    """One round over rows of vectors, with or without bounds: the rows again, and at the end of a task one row of its sums."""
    k = len(history[-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((k, 1 + width), np.int64)
        for f in batches:
            if not len(f):
                continue
            first, n = "upper" not in f.columns, len(f)
            b = Bounds(n, k)
            if first:
                x = np.stack(f["v"]).astype(np.int32)
            else:
                x = np.frombuffer(b"".join(f["v"]), np.int32).reshape(n, width)
                b.cluster = f["cluster"].to_numpy(np.int32, copy=True)
                b.upper, b.upper_round = f["upper"].to_numpy(copy=True), f["upper_round"].to_numpy(np.int16, copy=True)
                b.lower = np.frombuffer(b"".join(f["lower"]), np.float32).reshape(n, k).copy()
                b.lower_round = np.frombuffer(b"".join(f["lower_round"]), np.uint8).reshape(n, k).copy()
            assign(x, b, history, first)
            sums += _halves(x, b.cluster, k)
            yield pd.DataFrame({
                "vec_id": f["vec_id"], "v": [r.tobytes() for r in x], "cluster": b.cluster, "upper": b.upper, "upper_round": b.upper_round,
                "lower": [r.tobytes() for r in b.lower], "lower_round": [r.tobytes() for r in b.lower_round], "sums": None,
            })
        yield pd.DataFrame({"vec_id": [None], "v": None, "cluster": None, "upper": None, "upper_round": None, "lower": None, "lower_round": None, "sums": [sums.ravel()]}).astype({"cluster": "Int32", "upper_round": "Int16", "upper": "float64"})

    return run


def _next_centroids(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Floor of every cluster's mean; clusters without members stay where they are. The driver gets k * (1 + width) sums."""
    parts = state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x"))
    got = parts.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    sums = [[0] * (1 + before.shape[1]) for _ in before]
    for r in got:
        sums[r["at"] // (1 + before.shape[1])][r["at"] % (1 + before.shape[1])] = int(r["x"])
    return np.array([[s // row[0] for s in row[1:]] if row[0] else list(old) for row, old in zip(sums, before.tolist())], np.int64)


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable row of ``vectors`` (vec_id and ``column``).

    Rows whose vector is null, holds null or non-finite components or has not exactly
    ``width`` of them take no part; components become floor(256 * x) and stop at
    2 ** 27 either way, so that squared distances fit a long. The first centroids are
    the k vectors whose sha256 of ``seed:vec_id`` come first (all, if there are fewer;
    rows without vec_id last). Each of ``rounds`` rounds assigns every vector to the
    nearest centroid, ties to the smaller number, and moves every centroid that has
    members to the floor of their mean; then vectors are assigned once more. Rows that
    repeat count each time; inertia beyond a long stops at its end; other columns are
    not read; without usable rows the result is empty. ``rounds`` is at most 255.
    """
    if not 0 <= rounds <= 255:
        raise ValueError("rounds must lie in 0..255")
    kept = kept_vectors(vectors.select("vec_id", column), width, column)
    history = [first_centroids(kept, k, seed)]
    spark = vectors.sparkSession
    if not len(history[0]):
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).where("false")
    state = materialize(kept.mapInPandas(_pass(history, width), _STATE), "clusters")
    for _ in range(rounds):
        history.append(_next_centroids(state, history[-1]))
        old, state = state, materialize(state.where("sums IS NULL").drop("sums").mapInPandas(_pass(history, width), _STATE), "clusters")
        remove_table(old)  # the new state and the centroids are all that a lost executor needs
    return _report(spark, state.where("sums IS NULL"), history[-1])


def _report(spark: SparkSession, state: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if len(f):
                x = np.frombuffer(b"".join(f["v"]), np.int32).reshape(len(f), -1)
                yield pd.DataFrame({"vec_id": f["vec_id"], "cluster": f["cluster"], "distance": squared(x, centroids[f["cluster"].to_numpy()])})

    found = materialize(state.select("vec_id", "v", "cluster").mapInPandas(run, "vec_id long, cluster int, distance long"), "assigned")
    most = (1 << 63) - 1
    each = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    whole = min(most, sum(each.values()))
    named = [Row(cluster=j, cluster_inertia=min(most, each.get(j, 0)), inertia=whole, centroid_sha256=hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.nullif("vec_id", F.lit(_NULL_ID)).alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def clusters_sql(k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2) -> str:
    """DuckDB SQL for the same rows, one round after another."""
    parts = [
        f"""v AS MATERIALIZED (
              SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
              FROM embeddings
              WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (
              SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS j, v AS c
              FROM (SELECT v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h FROM v) ORDER BY h LIMIT {k})""",
    ]
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (
              SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d
              FROM (SELECT v.r, c{t}.j, list_sum(list_transform(list_zip(v.v, c{t}.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{t})
              GROUP BY r)""")
        if t < rounds:
            parts.append(f"""m{t} AS (
              SELECT j, list(CAST(floor((s - ((s % n) + n) % n) / n) AS BIGINT) ORDER BY i) AS c
              FROM (SELECT a.j, u.i, sum(u.x) AS s, count(*) AS n
                    FROM a{t} a JOIN (SELECT r, unnest(range(1, {width} + 1)) AS i, unnest(v) AS x FROM v) u USING (r) GROUP BY a.j, u.i)
              GROUP BY j)""")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.c, c.c) AS c FROM c{t} c LEFT JOIN m{t} m USING (j))")
    return "WITH " + ",\n            ".join(parts) + f"""
            SELECT v.vec_id, a.j AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
              CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
            FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""
