"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed for whole texts with numpy, batch by batch. Trees are
fitted on a bounded sample of labelled rows and flattened into arrays, which
workers walk for all documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_bytes, chunks_by_bytes, fresh, materialize, mix64, word_spans

#: Labelled rows that a fit takes at most, those with the smallest hash of doc_id.
MAX_LABELLED = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_CLASSES = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"|", b"#$%&*+=~^_@\\/<>", b"'\"()[]{}-`")):
    _CLASSES[list(_chars)] = _k + 1
N_CLASSES = 12
FEATURES = (
    [f"share_{c}" for c in ("other", "upper", "lower", "digit", "blank", "newline", "stop", "comma", "shout", "bar", "symbol", "quote")]
    + ["log_chars", "log_words", "word_length", "distinct_words", "distinct_pairs", "distinct_triples", "same_as_before", "line_length", "distinct_lines", "symbol_end", "words_per_stop", "short_words", "long_words"]
)


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each document."""
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty, and an empty text has zeros."""
    data = as_bytes(texts)
    out = np.zeros((len(data), len(FEATURES)), np.float32)
    for part in chunks_by_bytes([len(t) for t in data]):
        batch = data[part]
        n = len(batch)
        lengths = np.array([len(t) for t in batch], np.int64)
        a = np.frombuffer(b"".join(batch), np.uint8)
        doc = np.repeat(np.arange(n), lengths)
        counts = np.bincount(doc * N_CLASSES + _CLASSES[a], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        h, at, start, end = word_spans(batch)
        size = end - start
        words = np.diff(at)
        of = np.repeat(np.arange(n), words)
        same = of[1:] == of[:-1]
        two = mix64(h[1:] + h[:-1] * np.uint64(3))[same]
        three = same[1:] & same[:-1] if len(same) > 1 else np.zeros(0, bool)
        triples = mix64(h[2:] + h[1:-1] * np.uint64(3) + h[:-2] * np.uint64(7))[three] if len(h) > 2 else h[:0]
        offset = np.concatenate([[0], np.cumsum(lengths)])
        last = _CLASSES[a[np.repeat(offset[:-1], words) + end - 1]] if len(h) else np.zeros(0, np.int64)
        per = np.maximum(words, 1)
        lines = [t.split(b"\n") for t in batch]
        n_lines = np.array([len(x) for x in lines])
        rows = [counts[:, c] / np.maximum(lengths, 1) for c in range(N_CLASSES)]
        rows += [
            np.log1p(lengths), np.log1p(words), np.bincount(of, size, n) / per,
            _distinct(h, of, n) / per,
            _distinct(two, of[1:][same], n) / np.maximum(words - 1, 1),
            _distinct(triples, of[2:][three] if len(h) > 2 else of[:0], n) / np.maximum(words - 2, 1),
            np.bincount(of[1:][same & (h[1:] == h[:-1])], minlength=n) / per,
            lengths / n_lines,
            np.array([len(set(x)) for x in lines]) / n_lines,
            np.bincount(of[(last == 8) | (last == 10)], minlength=n) / per,
            words / (counts[:, 6] + 1),
            np.bincount(of[size <= 2], minlength=n) / per,
            np.bincount(of[size >= 16], minlength=n) / per,
        ]
        out[part] = np.where((lengths > 0)[:, None], np.stack(rows, 1), 0)
    return out


@dataclass
class Trees:
    """Boosted trees of equal depth as arrays: level by level, node k of a level has children 2k and 2k + 1."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2 ** depth
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 8.0, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss over equal-count bins. Without two classes the score is the label's, 0.5 without rows."""
    inner = 2**depth - 1
    p = y.mean() if len(y) else 0.5
    start = float(np.log(max(p, 1e-3) / max(1 - p, 1e-3)))
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), start)
    if len(y) < 2 or p in (0, 1):
        return none
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    raw = np.full(n, start)
    fs, ts, leaves = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, prob * (1 - prob)
        f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = (node - first) * bins
            best = np.zeros(width)
            cut_at = np.full(width, bins)
            for j in range(m):
                code = place + binned[:, j]
                gs = np.bincount(code, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(code, h, width * bins).reshape(width, bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[(hs < least / 4) | (ha - hs < least / 4)] = 0
                gain[:, len(cuts[j]) :] = 0
                k = gain.argmax(1)
                up = gain[np.arange(width), k] > best + 1e-9
                best = np.where(up, gain[np.arange(width), k], best)
                f[first : first + width] = np.where(up, j, f[first : first + width])
                cut_at = np.where(up, k, cut_at)
            for k in range(width):
                if cut_at[k] < bins:
                    t[first + k] = cuts[f[first + k]][cut_at[k]]
            right = x[np.arange(n), f[node]] > t[node]
            node = 2 * node + 1 + right
        code = node - inner
        leaf = rate * np.bincount(code, g, inner + 1) / (np.bincount(code, h, inner + 1) + ridge)
        raw += leaf[code]
        fs.append(f), ts.append(t), leaves.append(leaf)
    return Trees(np.stack(fs), np.stack(ts), np.stack(leaves), start)


def _fold():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    """Trees from labelled rows outside the held-out fold; at most ``max_labelled`` rows reach the driver, as statistics."""
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(_fold() != HELD_OUT).select("doc_id", F.col("quality").cast("double").alias("y"))
    sample = materialize(sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_labelled), "labelled")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = features(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": list(x)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(run, f"doc_id {kind}, y double, x array<float>").orderBy("doc_id", "y", "x").limit(max_labelled).toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return fit_trees(x.astype(np.float32), got["y"].to_numpy())


def quality_scores(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Scores depend on the text alone. held_out rows' labels are never learned from.
    Null and empty texts are scored by zero statistics; a null doc_id falls in the
    fold of the empty string; without usable labels every score is 0.5. Texts are read
    whole, whatever their length; rows that repeat get equal scores; other columns
    are not read; an empty table gives an empty one.
    """
    model = train(docs, labels, max_labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = model.scores(features(b.pop("text").tolist()))
            yield b[["doc_id", "held_out", "score"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (_fold() == HELD_OUT).alias("held_out"), "text")
    out = rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose predicted quality is 1, scored in place, so rows that repeat stay apart."""
    model = train(docs, labels, max_labelled)
    (mark,) = fresh(docs.columns, "_score")

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(features(text.tolist())))

    return docs.withColumn(mark, score("text")).where(F.col(mark) >= THRESHOLD).drop(mark)
