"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read from memory-mapped files.

Words are 64-bit hashes. Tasks count the bigrams of their texts and deal them,
packed, to shards: by the first word, or for words that begin a quarter of a shard's
bigrams or more by both, so that no shard gathers one word's bigrams. A shard
sorts and adds its bigrams and writes them as arrays to the shared folder; what
words have as a context and as a continuation is added up in shards of words.
Workers map the files they need and look sorted queries up in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import mapped, write_file
from .shared import as_bytes, chunks_by_bytes, materialize, mix64, shared_path, word_hashes

FOLDS, HELD_OUT = 7, 2
#: Characters of training text for each shard; a shard holds about a million bigrams.
SHARD_CHARS = 8_000_000
#: Characters for each bigram, about, and the part of a shard's bigrams from which a first word is split.
BIGRAM_CHARS, HEAVY_PART = 6, 4
#: Shards whose split words share a file; a shard has a few.
HEAVY_SHARDS = 1024
#: Characters that a task counts at once, and scores at once.
PORTION_CHARS, SCORE_CHARS = 5_000_000, 2_000_000
BEGIN, END = np.uint64(0x51ED270B0F0E0D0C), np.uint64(0xA3C59AC2B1D0E0F1)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _PAIR + b)


def _slot(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def heavy_words(path: str, shards: int) -> list[np.ndarray]:
    """Sorted words whose bigrams are split, by slot of a file; workers map the files."""
    raw = [mapped(f"{path}/heavy-{i}") for i in range(-(-shards // HEAVY_SHARDS))]
    return [np.zeros(0, np.uint64) if x is None else x.view(np.uint64) for x in raw]


def _shard(a: np.ndarray, b: np.ndarray, heavy: list[np.ndarray], n: int) -> np.ndarray:
    """Shard of each bigram."""
    out = _slot(a, n)
    split = np.zeros(len(a), bool)
    for words in heavy:
        if len(words):
            split |= words[np.minimum(np.searchsorted(words, a), len(words) - 1)] == a
    out[split] = _slot(pair_hash(a[split], b[split]), n)
    return out


def _tokens(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous word, word, document) of all tokens of the texts, an END after each text."""
    h, at = word_hashes(as_bytes(texts, ascii_lower=True))
    n = np.diff(at) + 1
    ends = np.cumsum(n) - 1
    word = np.empty(int(n.sum()), np.uint64)
    last = np.zeros(len(word), bool)
    last[ends] = True
    word[~last], word[last] = h, END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[ends - n + 1] = BEGIN
    return before, word, np.repeat(np.arange(len(n)), n)


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """The texts of batches, PORTION_CHARS characters at a time (or one text)."""
    for b in batches:
        texts = b["text"].tolist()
        for part in chunks_by_bytes([len(t or "") for t in texts], PORTION_CHARS):
            yield texts[part]


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs added up: (pair hash, a, b, count), by pair hash."""
    key = pair_hash(a, b)
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(c, first) if len(key) else c
    return key[first], a[order[first]], b[order[first]], total


def _dealt(shard: np.ndarray, shards: int, **columns: np.ndarray) -> pd.DataFrame:
    """A row for each shard that has entries, its columns packed as bytes."""
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edge))
    out = {"shard": full}
    for name, x in columns.items():
        x = x[order]
        out[name] = [x[edge[s] : edge[s + 1]].tobytes() for s in full]
    return pd.DataFrame(out)


@dataclass
class Model:
    """What a worker needs to open the model."""

    path: str
    shards: int
    tokens: int
    words: int
    pairs: int
    pair_discount: tuple[float, float, float]
    word_discount: tuple[float, float, float]
    word_backoff: float

    @property
    def heavy(self) -> np.ndarray:
        """All words whose bigrams are split."""
        return np.concatenate(heavy_words(self.path, self.shards))

    def _rows(self, kind: str, shard: np.ndarray, key: np.ndarray, fields: tuple[str, ...]) -> np.ndarray:
        """Rows of a table's arrays for keys, zero where absent; each shard's keys are looked up in order."""
        out = np.zeros((len(key), len(fields)), np.uint64)
        order = np.lexsort((key, shard))
        edge = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edge)):
            mine = order[edge[s] : edge[s + 1]]
            raw = mapped(f"{self.path}/{kind}-{s}")
            if raw is None or not len(raw):
                continue
            keys, values = _read(raw, len(fields))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key[mine]), len(keys) - 1)
                hit = keys[at] == key[mine]
                for j, v in enumerate(values):
                    out[mine[hit], j] = v[at[hit]]
        return out

    def score(self, texts: list) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score (log10) of each text."""
        a, b, doc = _tokens(texts)
        words, of = np.unique(np.concatenate([a, b]), return_inverse=True)
        w = self._rows("words", _slot(words, self.shards), words, WORD_FIELDS).astype(np.float64)
        count, types = w[:, 0], w[:, 1]
        low = (np.maximum(types - _discount(types, self.word_discount), 0) + self.word_backoff / (self.words + 1)) / max(self.pairs, 1) if self.pairs else np.full(len(words), 1 / (self.words + 1))
        total = w[:, 2]
        d = self.pair_discount
        back = (w[:, 3] * d[0] + w[:, 4] * d[1] + w[:, 5] * d[2]) / np.maximum(total, 1)
        key, first, inverse = np.unique(pair_hash(a, b), return_index=True, return_inverse=True)
        pa, pb = a[first], b[first]
        ia, ib = of[: len(a)][first], of[len(a) :][first]
        c = self._rows("pairs", _shard(pa, pb, heavy_words(self.path, self.shards), self.shards), key, ("count",))[:, 0].astype(np.float64)
        p = np.where(total[ia] > 0, np.maximum(c - _discount(c, d), 0) / np.maximum(total[ia], 1) + back[ia] * low[ib], low[ib])
        n = len(texts)
        ib = of[len(a) :]
        base = np.log10((count[ib] + 1) / (self.tokens + self.words + 1))
        return pd.DataFrame({
            "n_tokens": np.bincount(doc, minlength=n), "n_known": np.bincount(doc[count[ib] > 0], minlength=n),
            "base_score": np.bincount(doc, base, n), "score": np.bincount(doc, np.log10(p)[inverse], n),
        })


#: count of the word, bigrams it ends, tokens after it, and bigrams it begins that occur once, twice, more often.
WORD_FIELDS = ("count", "types", "total", "once", "twice", "more")


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from how many entries occur 1, 2, 3 and 4 times; 0.5, 1 and 1.5 if one of them is none."""
    if min(n) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3))  # type: ignore[return-value]


def _arrays(frame: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(frame[name]), kind)


def _store(path: str, keys: np.ndarray, *values: np.ndarray) -> None:
    """Keys and fields of a shard. A field is 32 bits wide, or 64 if one of its values needs that; the head says which."""
    wide = [bool(len(v)) and int(v.max()) > 0xFFFFFFFF for v in values]
    head = np.array([len(keys), *wide], np.uint64)
    write_file(path, head.tobytes() + keys.tobytes() + b"".join(v.astype(np.uint64 if w else np.uint32).tobytes() for v, w in zip(values, wide)))


def _read(raw: np.ndarray, fields: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and fields that ``_store`` wrote."""
    n, *wide = (int(x) for x in raw[: 8 * (1 + fields)].view(np.uint64))
    at = 8 * (1 + fields)
    keys, at = raw[at : at + 8 * n].view(np.uint64), at + 8 * n
    values = []
    for w in wide:
        size = n * (8 if w else 4)
        values.append(raw[at : at + size].view(np.uint64 if w else np.uint32))
        at += size
    return keys, values


def fit(docs: DataFrame) -> Model:
    """Count all texts of ``docs`` (text; null as empty) and write the model to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select("text")
    size = texts.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    shards = max(1, ((size[0] or 0) + 8 * size[1]) // SHARD_CHARS)
    path = shared_path(spark, "ngrams")

    heavy_from = SHARD_CHARS // (BIGRAM_CHARS * HEAVY_PART)
    most = (size[0] or 0) // 2 + 2 * size[1] + 1  # a word takes two characters at least, but for the last of a text

    def first_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words that begin a share of the bigrams of a portion, so small that what is left out adds up to half of heavy_from at most."""
        for texts in _portions(batches):
            before, _, _ = _tokens(texts)
            words, n = np.unique(before, return_counts=True)
            keep = n >= heavy_from * len(before) / (2.0 * most)  # in floating point: the products pass 64 bits in a large corpus
            yield pd.DataFrame({"h": words[keep].view(np.int64), "n": n[keep]})

    def write_heavy(frame: pd.DataFrame) -> pd.DataFrame:
        write_file(f"{path}/heavy-{int(frame['slot'].iloc[0])}", np.sort(frame["h"].to_numpy().view(np.uint64)).tobytes())
        return frame[["slot"]].head(1)

    # Every word that begins heavy_from bigrams is found. There are fewer than 2 * tokens / heavy_from of them, some words for each shard.
    found = texts.mapInPandas(first_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(2 * F.col("n") >= heavy_from)
    slot = F.pmod(F.col("h"), F.lit(-(-shards // HEAVY_SHARDS))).alias("slot")
    materialize(found.select("h", slot).groupBy("slot").applyInPandas(write_heavy, "slot long"), "heavy")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in _portions(batches):
            before, word, _ = _tokens(texts)
            _, x, y, c = _added(before, word, np.ones(len(word), np.uint32))
            order = np.argsort(x, kind="stable")  # runs of one first word compress well
            x, y, c = x[order], y[order], c[order].astype(np.uint32)  # sums come as 64 bits
            yield _dealt(_shard(x, y, heavy_words(path, shards), shards), shards, a=x, b=y, n=c)

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        s = int(frame["shard"].iloc[0])
        key, a, b, c = _added(_arrays(frame, "a", np.uint64), _arrays(frame, "b", np.uint64), _arrays(frame, "n", np.uint32).astype(np.int64))
        _store(f"{path}/pairs-{s}", key, c)
        seen = [int((c == k).sum()) for k in (1, 2, 3, 4)]
        words, i = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = i[: len(a)], i[len(a) :]
        n = len(words)
        columns = (np.bincount(j, c, n), np.bincount(j, minlength=n), np.bincount(i, c, n), np.bincount(i[c == 1], minlength=n), np.bincount(i[c == 2], minlength=n), np.bincount(i[c > 2], minlength=n))
        out = _dealt(_slot(words, shards), shards, w=words, **{f: x.astype(np.int64 if f in ("count", "total") else np.uint32) for f, x in zip(WORD_FIELDS, columns)})
        out["stats"] = [seen if k == 0 else None for k in range(len(out))]
        return out

    blobs = ", ".join(f"{f} binary" for f in WORD_FIELDS)
    pieces = texts.mapInPandas(count, "shard long, a binary, b binary, n binary")
    added = pieces.groupBy("shard").applyInPandas(add, f"shard long, w binary, {blobs}, stats array<long>")
    added = materialize(added, "words")
    row = added.where("stats IS NOT NULL").agg(*[F.sum(F.col("stats")[k]) for k in range(4)]).first()
    pair_discount = discounts([int(x or 0) for x in row])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        s = int(frame["shard"].iloc[0])
        words, i = np.unique(_arrays(frame, "w", np.uint64), return_inverse=True)
        columns = [np.bincount(i, _arrays(frame, f, np.int64 if f in ("count", "total") else np.uint32), len(words)).astype(np.int64) for f in WORD_FIELDS]
        _store(f"{path}/words-{s}", words, *columns)
        t = columns[1]
        return pd.DataFrame([{"tokens": int(columns[0].sum()), "words": int((t > 0).sum()), "pairs": int(t.sum()), **{f"n{k}": int((t == k).sum()) for k in (1, 2, 3, 4)}}])

    sums = materialize(added.drop("stats").groupBy("shard").applyInPandas(merge, "tokens long, words long, pairs long, n1 long, n2 long, n3 long, n4 long"), "totals")
    t = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns]).first()
    d = discounts([t["n1"], t["n2"], t["n3"], t["n4"]])
    more = t["words"] - t["n1"] - t["n2"]
    return Model(path, shards, t["tokens"], t["words"], t["pairs"], pair_discount, d, d[0] * t["n1"] + d[1] * t["n2"] + d[2] * more)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    Tokens are the words (A-Z lower-cased, parted by ASCII white space) and one
    end for each text; null text counts as empty. Rows whose crc32(doc_id as text)
    mod 7 is not 2 are learned from, a null doc_id as the empty string; rows that
    repeat count each time. Without training rows every probability is 1. Texts are read
    whole, a longer one than a portion by itself; other columns are not read; an
    empty table gives an empty one.
    """
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    docs = docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text")
    model = fit(docs.where("NOT held_out"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("text").tolist()
            for at in chunks_by_bytes([len(t or "") for t in texts], SCORE_CHARS):
                part = b.iloc[at].reset_index(drop=True)
                got = model.score(texts[at])
                yield pd.concat([part, got], axis=1).assign(train_tokens=model.tokens)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
