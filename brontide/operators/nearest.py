"""k nearest nodes by blocks with bounding boxes: exact, in two passes over what the boxes leave possible.

Nodes are packed along a Morton curve into blocks. There are at most MOST_BLOCKS of
them, however many nodes, so the boxes are a table of bounded size that tasks hold. A
place first meets the block whose box is nearest; the distance it finds there stops all
blocks whose boxes lie farther, and it meets those that are left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LEAST_NODES, MOST_BLOCKS = 256, 1 << 14
#: Blocks whose boxes share a wider box; places that look at boxes together.
FANOUT, TOGETHER = 128, 64
#: Places of a block that one task takes.
PLACES_AT_ONCE = 50_000
_GRID = (1 << 16) - 1


def _spread(x: Column) -> Column:
    """The 16 bits of a number, with a gap after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(x: Column, y: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Place of a point along a curve that keeps near points near, over a box."""
    on = lambda v, a, b: F.least(F.greatest(F.floor((v - a) / ((b - a) or 1.0) * _GRID), F.lit(0)), F.lit(_GRID)).cast("long")
    return _spread(on(x, low[0], high[0])).bitwiseOR(F.shiftleft(_spread(on(y, low[1], high[1])), 1))


def _column(x: np.ndarray) -> pd.Series | np.ndarray:
    """Ids as a column; texts as plain objects, which Arrow takes in one piece."""
    return x if x.dtype.kind in "iu" else pd.Series(x.astype(object), dtype=object)


@dataclass
class Boxes:
    """Boxes of blocks, as (x0, x1, y0, y1) and how many nodes each has; in groups of FANOUT, each with a box around."""

    block: np.ndarray
    box: np.ndarray
    nodes: np.ndarray

    def __post_init__(self) -> None:
        n = -(-len(self.block) // FANOUT)
        edge = np.arange(n) * FANOUT
        low, high = np.minimum.reduceat(self.box, edge), np.maximum.reduceat(self.box, edge)
        self.wide = np.stack([low[:, 0], high[:, 1], low[:, 2], high[:, 3]], axis=1)
        self.wide_nodes = np.add.reduceat(self.nodes, edge)


def _gaps(x: np.ndarray, y: np.ndarray, w: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (places, boxes) to the nearest and to the farthest point of each box."""
    x, y, w = x[:, None], y[:, None], w[:, None]
    dx = np.maximum(np.maximum(box[:, 0] - x, x - box[:, 1]), 0) * w
    dy = np.maximum(np.maximum(box[:, 2] - y, y - box[:, 3]), 0)
    fx = np.maximum(np.abs(x - box[:, 0]), np.abs(x - box[:, 1])) * w
    fy = np.maximum(np.abs(y - box[:, 2]), np.abs(y - box[:, 3]))
    return dx * dx + dy * dy, fx * fx + fy * fy


def possible_blocks(x: np.ndarray, y: np.ndarray, w: np.ndarray, bound: np.ndarray, boxes: Boxes, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, box, squared distance) of every box that may hold one of a place's k nearest nodes, TOGETHER places at a time.

    A box that has k nodes bounds the k-th distance by its farthest point; ``bound`` holds what is known besides.
    """
    slack = 1 + 1e-9
    order = np.lexsort((x, np.round(y, 1)))
    for at in range(0, len(order), TOGETHER):
        i = order[at : at + TOGETHER]
        near, far = _gaps(x[i], y[i], w[i], boxes.wide)
        most = np.minimum(bound[i], np.where(boxes.wide_nodes >= k, far, np.inf).min(1, initial=np.inf))
        groups = np.flatnonzero((near <= (most * slack)[:, None]).any(0))
        rows = (groups[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        rows = rows[rows < len(boxes.block)]
        near, far = _gaps(x[i], y[i], w[i], boxes.box[rows])
        most = np.minimum(most, np.where(boxes.nodes[rows] >= k, far, np.inf).min(1, initial=np.inf))
        p, b = np.nonzero(near <= (most * slack)[:, None])
        yield i[p], rows[b], near[p, b]


def node_blocks(nodes: DataFrame) -> DataFrame:
    """(block, x0, x1, y0, y1, n, ids, xs, ys) from (id, x, y): nodes along the curve, so many a block that there are at most about MOST_BLOCKS."""
    row = nodes.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n = row[0]
    size = max(LEAST_NODES, -(-2 * n // MOST_BLOCKS))
    kind = nodes.schema["id"].dataType.simpleString()
    code = morton(F.col("x"), F.col("y"), (row[1] or 0.0, row[3] or 0.0), (row[2] or 0.0, row[4] or 0.0))
    parts = max(1, min(MOST_BLOCKS // 4, n // (8 * size)))
    rows = nodes.withColumn("_code", code).repartitionByRange(parts, "_code").sortWithinPartitions("_code", "x", "y", "id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, held, i = TaskContext.get().partitionId() << 32, None, 0  # type: ignore[union-attr]

        def block(f: pd.DataFrame) -> dict:
            x, y = f["x"].to_numpy(float), f["y"].to_numpy(float)
            return {"block": base + i, "x0": x.min(), "x1": x.max(), "y0": y.min(), "y1": y.max(), "n": len(f), "ids": f["id"].tolist(), "xs": x.tobytes(), "ys": y.tobytes()}

        for b in batches:
            f = b if held is None else pd.concat([held, b], ignore_index=True)
            out = []
            while len(f) >= 2 * size:
                out.append(block(f.iloc[:size]))
                f, i = f.iloc[size:], i + 1
            held = f
            if out:
                yield pd.DataFrame(out)
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    return materialize(rows.mapInPandas(pack, f"block long, x0 double, x1 double, y0 double, y1 double, n long, ids array<{kind}>, xs binary, ys binary"), "node-blocks")


def _meet(places: DataFrame, blocks: DataFrame, k: int, key_kind: str, id_kind: str) -> DataFrame:
    """(key, id, dist2): each place's k nearest nodes of each block that it is sent to (key, x, y, w, block)."""
    sent = materialize(places, "sent")
    many = {r["block"]: -(-r["n"] // PLACES_AT_ONCE) for r in sent.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_BLOCKS rows or so
    busy = {b: m for b, m in many.items() if m > 1}
    copies = F.coalesce(*[F.when(F.col("block") == b, F.lit(m)) for b, m in busy.items()], F.lit(1)) if len(busy) <= 200 else F.lit(max(busy.values()))
    left = sent.withColumn("part", F.pmod(F.xxhash64("key"), copies.cast("long")))
    right = blocks.select("block", "ids", "xs", "ys").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)))

    def find(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(b):
            return pd.DataFrame({"key": [], "id": [], "dist2": []}, dtype=object)
        ids = np.asarray(b["ids"].iloc[0])
        x, y = np.frombuffer(b["xs"].iloc[0]), np.frombuffer(b["ys"].iloc[0])
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        ids, x, y = ids[order], x[order], y[order]
        keys, out = p["key"].to_numpy(), []
        px, py, w = (p[c].to_numpy(float) for c in ("x", "y", "w"))
        step, m = max(1, (1 << 20) // len(ids)), min(k, len(ids))
        for at in range(0, len(p), step):
            s = slice(at, at + step)
            d = (y - py[s, None]) ** 2 + ((x - px[s, None]) * w[s, None]) ** 2
            best = d.argmin(1)[:, None] if m == 1 else np.argsort(d, axis=1, kind="stable")[:, :m]
            out.append(pd.DataFrame({"key": _column(np.repeat(keys[s], m)), "id": _column(ids[best].ravel()), "dist2": np.take_along_axis(d, best, 1).ravel()}))
        return pd.concat(out, ignore_index=True)

    pair = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return pair.applyInPandas(find, f"key {key_kind}, id {id_kind}, dist2 double")


def k_nearest(places: DataFrame, nodes: DataFrame, k: int = 1, wrap: float | None = None) -> DataFrame:
    """(key, id, dist2, rank): the k nodes (id, x, y) nearest to each place (key, x, y, w), all if fewer, ties to the smaller id.

    dist2 = (y - y') ** 2 + (w * (x - x')) ** 2, w being the place's own scale of x (the cosine
    of its latitude, say; nought at a pole). With ``wrap`` x goes around a circle of that length.
    Places and nodes with missing coordinates take no part.
    """
    there = lambda df: df.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    cast = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    nodes = there(nodes.select("id", *cast)).where("id IS NOT NULL")
    if wrap:
        turns = F.explode(F.array(F.lit(-float(wrap)), F.lit(0.0), F.lit(float(wrap))))
        nodes = nodes.withColumn("_t", turns).withColumn("x", F.col("x") + F.col("_t")).drop("_t")
    places = there(places.select("key", *cast, F.col("w").cast("double").alias("w")))
    key_kind, id_kind = (df.schema[c].dataType.simpleString() for df, c in ((places, "key"), (nodes, "id")))
    blocks = node_blocks(nodes)
    held = blocks.select("block", "x0", "x1", "y0", "y1", "n").orderBy("block").toPandas()  # about MOST_BLOCKS rows at most
    if not len(held):
        return places.sparkSession.createDataFrame([], f"key {key_kind}, id {id_kind}, dist2 double, rank int")
    boxes = Boxes(held["block"].to_numpy(), held[["x0", "x1", "y0", "y1"]].to_numpy(float), held["n"].to_numpy())
    wanted = 3 * k if wrap else k  # images of a node count once in the end

    def send(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                x, y, w = (f[c].to_numpy(float) for c in ("x", "y", "w"))
                bound = np.full(len(f), np.inf) if first else f["bound"].fillna(np.inf).to_numpy(float)
                for p, b, d in possible_blocks(x, y, w, bound, boxes, wanted):
                    if first:
                        order = np.lexsort((d, p))
                        keep = order[np.concatenate([[True], np.diff(p[order]) != 0])] if len(p) else order
                    else:
                        keep = np.flatnonzero(boxes.block[b] != f["block"].to_numpy()[p])
                    p, b = p[keep], b[keep]
                    yield pd.DataFrame({"key": _column(f["key"].to_numpy()[p]), "x": x[p], "y": y[p], "w": w[p], "block": boxes.block[b]})

        return run

    schema = f"key {key_kind}, x double, y double, w double, block long"
    firsts = materialize(places.mapInPandas(send(True), schema), "first-blocks")
    near = materialize(_meet(firsts, blocks, wanted, key_kind, id_kind), "nearest")
    kth = near.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("dist2").alias("_d")).select("key", F.when(F.col("_n") >= wanted, F.col("_d")).alias("bound"))
    rest = firsts.dropDuplicates(["key"]).join(kth, "key").select("key", "x", "y", "w", "block", "bound").mapInPandas(send(False), schema)
    both = near.unionByName(_meet(rest, blocks, wanted, key_kind, id_kind)).groupBy("key", "id").agg(F.min("dist2").alias("dist2"))
    best = Window.partitionBy("key").orderBy("dist2", "id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
