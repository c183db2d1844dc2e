"""Gradient-boosted rankers in Spark: lambda gradients inside groups, trees grown level by level from histograms that tasks add up.

Rows of a group (the sources of one place and time) are packed into one row of a
written table, features as bins. A pass over that table scores every group with the
trees so far, takes the lambda gradients of its pairs, and adds gradients up by node,
feature and bin; the driver gets these sums, whose number does not depend on the rows,
and picks each node's split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Pairs looked at together.
PAIRS_AT_ONCE = 1 << 20


@dataclass
class RankTrees:
    """Complete binary trees over binned features: a node's feature (-1: all rows go left), the last bin that goes left, and the leaves' values."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    depth: int
    rate: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        """Bin of each value: how many cuts lie below it; missing values are in the first."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for j, (x, cuts) in enumerate(zip(columns, self.cuts)):
            out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(cuts, x, side="left"))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, value in self.trees:
            out += self.rate * value[_walk(x, feature, cut, self.depth)]
        return out


def _walk(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes of a level."""
    at = np.zeros(len(x), np.int64)
    for level in range(levels):
        node = at + (1 << level) - 1
        f = feature[node]
        right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node])
        at = 2 * at + right
    return at


def lambda_gradients(score: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(gradients, second derivatives) of groups of one size, as (groups, members): each pair of different labels pulls its members apart by the change of NDCG@k that swapping them makes.

    A label is its own gain; places after the k-th count nothing; equal scores rank by their order.
    """
    q, m = score.shape
    order = np.argsort(-score, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(m), (q, m)), axis=1)
    weight = 1 / np.log2(np.arange(2, m + 2))
    weight[k:] = 0
    best = (-np.sort(-label, axis=1) * weight).sum(1)
    scale = np.divide(1.0, best, out=np.zeros(q), where=best > 0)
    of_place = weight[place]
    g, h = np.zeros((q, m)), np.zeros((q, m))
    step = max(1, PAIRS_AT_ONCE // max(1, q * m))
    for i in range(0, m, step):  # some members against all
        s = slice(i, min(m, i + step))
        gain = label[:, s, None] - label[:, None, :]
        delta = np.abs(gain) * np.abs(of_place[:, s, None] - of_place[:, None, :]) * scale[:, None, None]
        lose = 1 / (1 + np.exp(np.clip(np.sign(gain) * (score[:, s, None] - score[:, None, :]), -60, 60)))
        pull = delta * lose
        g[:, s] -= (np.sign(gain) * pull).sum(2)
        h[:, s] += (np.abs(np.sign(gain)) * pull * (1 - lose)).sum(2)
    return g, h


def ndcg_sum(score: np.ndarray, label: np.ndarray, k: int, times: np.ndarray | None = None) -> tuple[float, float]:
    """Sum of NDCG@k over groups that have a gain, and how many these are; ``times`` says how often each group came."""
    order = np.argsort(-score, axis=1, kind="stable")
    weight = 1 / np.log2(np.arange(2, score.shape[1] + 2))
    weight[k:] = 0
    best = (-np.sort(-label, axis=1) * weight).sum(1)
    got = (np.take_along_axis(label, order, axis=1) * weight).sum(1)
    some = best > 0
    times = np.ones(len(some)) if times is None else times
    return float((got[some] / best[some] * times[some]).sum()), float(times[some].sum())


def _by_size(n: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers (groups, members) of groups of one size, PAIRS_AT_ONCE pairs at a time (or one group)."""
    at = np.concatenate([[0], np.cumsum(n)])
    for m in np.unique(n):
        begin = at[:-1][n == m]
        step = max(1, int(PAIRS_AT_ONCE // (m * m)))
        for i in range(0, len(begin), step):
            yield begin[i : i + step, None] + np.arange(m)


def pack_groups(df: DataFrame, group: Sequence[str], model: RankTrees, relevance: str, times: str | None = None) -> DataFrame:
    """(x, y, n, w): a row for each group, bins and labels of its members as bytes, their number, and how often the group came. Members of a group meet in one task."""
    names = [f"_f{j}" for j in range(len(model.features))]
    keys = [F.xxhash64(*group).alias("_g"), F.xxhash64(F.lit(7), *group).alias("_h")]
    values = [F.col(f).cast("double").alias(n) for f, n in zip(model.features, names)]
    came = (F.col(times) if times else F.lit(1)).cast("double").alias("_w")
    rows = df.where(F.col(relevance).isNotNull()).select(*keys, F.col(relevance).cast("double").alias("_y"), *values, came)
    rows = rows.repartition("_g", "_h").sortWithinPartitions("_g", "_h", "_y", *names)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        key = f[["_g", "_h"]].to_numpy()
        first = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(f)]])
        x = model.bins([f[n].to_numpy(float) for n in names])
        y = f["_y"].to_numpy(float)
        cut = list(zip(first[:-1], first[1:]))
        return pd.DataFrame({"x": [x[a:b].tobytes() for a, b in cut], "y": [y[a:b].tobytes() for a, b in cut], "n": np.diff(first), "w": f["_w"].to_numpy(float)[first[:-1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            if len(b):
                f = b if held is None else pd.concat([held, b], ignore_index=True)
                last = (f["_g"] == f["_g"].iloc[-1]) & (f["_h"] == f["_h"].iloc[-1])
                held = f[last].reset_index(drop=True)
                if not last.all():
                    yield pack(f[~last].reset_index(drop=True))
        if held is not None:
            yield pack(held)

    return materialize(rows.mapInPandas(run, "x binary, y binary, n long, w double"), "groups")


def _sums(packed: DataFrame, size: int, of_batch) -> np.ndarray:
    """What ``of_batch(x, y, n, w, out)`` adds to ``size`` numbers, over all groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size)
        for b in batches:
            if len(b):
                n = b["n"].to_numpy()
                y = np.frombuffer(b"".join(b["y"]), float)
                of_batch(np.frombuffer(b"".join(b["x"]), np.uint8).reshape(len(y), -1), y, n, b["w"].to_numpy(), out)
        yield pd.DataFrame({"s": [out]})

    parts = packed.mapInPandas(run, "s array<double>").select(F.posexplode("s").alias("at", "v"))
    total = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():  # size rows
        total[r["at"]] = r["v"]
    return total


def _split(sums: np.ndarray, least: int, smooth: float) -> tuple[int, int]:
    """(feature, last bin to the left) with the highest gain of one node's (features, bins, [g, h, n]); -1 if none gains."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    fit = lambda s: s[..., 0] ** 2 / (s[..., 1] + smooth)
    gain = fit(left) + fit(right) - fit(whole)
    gain[(left[..., 2] < least) | (right[..., 2] < least)] = -np.inf
    at = int(gain.argmax())
    f, b = divmod(at, sums.shape[1])
    return (f, b) if gain[f, b] > 1e-9 else (-1, 0)


def _cuts(train: DataFrame, features: Sequence[str], bins: int, times: str | None) -> list[np.ndarray]:
    """Quantiles that part each feature into ``bins`` bins. Rows that came several times weigh as often, by the weights between 100 times as many quantiles of the rows as they are."""
    values = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
    parts = 100 * bins if times else bins
    row = train.agg(*[F.percentile_approx(v, [i / parts for i in range(1, parts + bool(times))], 100 * bins).alias(f"c{j}") for j, v in enumerate(values)]).first()
    cuts = [np.unique(np.array(row[f"c{j}"] or [], float)) for j in range(len(features))]
    if not times:
        return cuts
    ends = np.cumsum([len(c) for c in cuts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(sum(map(len, cuts)))
        for b in batches:
            for j, c in enumerate(cuts):
                x, w = b[f"_f{j}"].to_numpy(float), b["_w"].to_numpy(float)
                known = ~np.isnan(x) & (len(c) > 0)
                at = np.minimum(np.searchsorted(c, x[known], side="left"), len(c) - 1)  # the least cut that is not below the value
                out[ends[j] - len(c) : ends[j]] += np.bincount(at, w[known], len(c))
        yield pd.DataFrame({"at": np.arange(len(out)), "v": out})

    total = np.zeros(sum(map(len, cuts)))
    came = train.select(*[v.alias(f"_f{j}") for j, v in enumerate(values)], F.col(times).cast("double").alias("_w"))
    for r in came.mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # a row for each cut
        total[r["at"]] = r["v"]
    out = []
    for c, e in zip(cuts, ends):
        below = np.cumsum(total[e - len(c) : e])
        wanted = np.arange(1, bins) / bins * (below[-1] if len(c) else 0)
        out.append(np.unique(c[np.minimum(np.searchsorted(below, wanted, side="left"), len(c) - 1)]) if len(c) else c)
    return out


def fit_lambda_ranker(
    train: DataFrame, group: Sequence[str], features: Sequence[str], relevance: str = "relevance", k: int = 3, trees: int = 30,
    depth: int = 4, rate: float = 0.1, bins: int = 32, least: int = 50, smooth: float = 1.0, val: DataFrame | None = None, patience: int = 5, times: str | None = None,
) -> RankTrees:
    """LambdaMART: trees on the lambda gradients of NDCG@k, each node's split from histograms, each leaf a Newton step.

    Labels are their own gains. With ``val`` the rounds end when NDCG@k on it has not
    risen for ``patience`` rounds, and the trees up to its highest value stay. Missing features
    fall into the first bin; rows without a label take no part. A group is taken whole by one task; groups are the
    candidates of one decision, so they are small. Groups that are alike may be given once: the column ``times``, the
    same in all rows of a group, then says how often it came.
    """
    features, bins = tuple(features), min(bins, 255)
    model = RankTrees(features, _cuts(train, features, bins, times), depth, rate)
    packed = pack_groups(train, group, model, relevance, times)
    checked = pack_groups(val, group, model, relevance, times) if val is not None else None
    best, best_at = -1.0, 0
    for _ in range(trees):
        model.trees.append(_grow(packed, model, k, bins, least, smooth))
        if checked is not None:
            now = _ndcg(checked, model, k)
            if now > best:
                best, best_at = now, len(model.trees)
            elif len(model.trees) - best_at >= patience:
                break
    if checked is not None:
        del model.trees[best_at:]
    return model


def _grow(packed: DataFrame, model: RankTrees, k: int, bins: int, least: int, smooth: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feature, cut = np.full((1 << model.depth) - 1, -1), np.zeros((1 << model.depth) - 1, np.int64)
    width = len(model.features)

    def at_level(level: int, f: np.ndarray, c: np.ndarray):
        def add(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
            score, each = model.score(x), np.repeat(w, n)
            g, h = np.zeros(len(y)), np.zeros(len(y))
            for rows in _by_size(n):
                g[rows], h[rows] = lambda_gradients(score[rows], y[rows], k)
            node = _walk(x, f, c, level)
            for j in range(width):
                slot = (node * width + j) * bins + x[:, j]
                for i, v in enumerate((g * each, h * each, each)):
                    out[i::3] += np.bincount(slot, v, (width * bins) << level)

        return add

    for level in range(model.depth):
        got = _sums(packed, (width * bins * 3) << level, at_level(level, feature.copy(), cut.copy())).reshape(1 << level, width, bins, 3)
        for i, sums in enumerate(got):
            node = i + (1 << level) - 1
            feature[node], cut[node] = _split(sums, least, smooth)
    # The last level's histograms hold the leaves' sums.
    value = np.zeros(1 << model.depth)
    for i, sums in enumerate(got):
        node = i + (1 << (model.depth - 1)) - 1
        whole = sums[0].sum(0)
        left = sums[feature[node], : cut[node] + 1].sum(0) if feature[node] >= 0 else whole
        for side, s in ((0, left), (1, whole - left)):
            value[2 * i + side] = -s[0] / (s[1] + smooth)
    return feature, cut, value


def _ndcg(packed: DataFrame, model: RankTrees, k: int) -> float:
    def add(x: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, out: np.ndarray) -> None:
        score, each = model.score(x), np.repeat(w, n)
        for rows in _by_size(n):
            s, c = ndcg_sum(score[rows], y[rows], k, each[rows[:, 0]])
            out += [s, c]

    s, c = _sums(packed, 2, add)
    return s / c if c else 0.0


def rank_by_trees(model: RankTrees, df: DataFrame, out: str = "rank_score") -> DataFrame:
    """``df`` with the model's score of each row, by batches of Arrow columns: a walk through some dozen trees is array work."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(model.bins([c.to_numpy(float) for c in columns])))

    return df.withColumn(out, score(*[F.col(f).cast("double") for f in model.features]))
