"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

One scan of the documents keeps, for every document, how often it holds the terms
that the items ask for, and adds up what the weights need. Then tasks sort their
documents' entries by term and impact and answer every item on them. Reading an
item's lists from the top, in steps that double, gives each document a lower score
(what has been read) and an upper one (for lists it has not been met in, at most the
impact that comes next there). A document whose upper score lies below the k-th best
lower score is out. Reading goes on until every document that is left has equal lower
and upper scores, so members, ties and scores are all settled. A task takes its best
documents of earlier blocks along as the bar of the next.

Items are asked in blocks of about BLOCK_TERMS terms; a block's terms and weights lie
in array files of the shared folder that workers map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import mapped, write_file
from .shared import as_bytes, chunks_by_bytes, materialize, shared_path, word_spans

#: Distinct terms of all items of a block together, on average (one item may have more).
BLOCK_TERMS = 1 << 20
#: Entries of documents that a task sorts and searches at once, and its documents at most.
BLOCK_ENTRIES, BLOCK_DOCS = 2_000_000, 1 << 16
#: Entries read from each list in the first step.
FIRST_READ = 64
#: Characters hashed at once.
PORTION_CHARS = 2_000_000
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Stands for a null doc_id inside, so that ids stay whole numbers in tasks.
_NULL_ID = (1 << 63) - 1


def _terms(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of texts, and where each text's begin."""
    return word_spans(as_bytes(texts, ascii_lower=True), _NO_TERM)[:2]


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, terms, times): distinct term hashes of each item and how often it has them."""
    for b in batches:
        h, at = _terms(b["text"].tolist())
        found = [np.unique(h[s:e], return_counts=True) for s, e in zip(at[:-1], at[1:])]
        yield pd.DataFrame({"item_id": b["item_id"], "terms": [t.view(np.int64) for t, _ in found], "times": [n.astype(np.int64) for _, n in found]})


def _entries(vocabulary_path: str):
    """(doc_id, n, terms, tf) of documents with a term of the vocabulary, packed; a task's last row has its statistics.

    Statistics: documents with terms, terms with repeats, and the documents that hold each term of the vocabulary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = mapped(vocabulary_path).view(np.uint64)
        stats = np.zeros(2 + len(vocabulary), np.int64)
        for b in batches:
            texts = b["text"].tolist()
            for part in chunks_by_bytes([len(t or "") for t in texts], PORTION_CHARS):
                h, at = _terms(texts[part])
                n = np.diff(at)
                stats[0] += int((n > 0).sum())
                stats[1] += int(n.sum())
                i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[i] == h)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                key, tf = np.unique(doc * len(vocabulary) + i[hit], return_counts=True)
                doc, term = key // len(vocabulary), key % len(vocabulary)
                stats[2:] += np.bincount(term, minlength=len(vocabulary))
                edge = np.searchsorted(doc, np.arange(len(n) + 1))
                some = np.flatnonzero(np.diff(edge))
                term, tf = term.astype(np.uint32), tf.astype(np.uint32)
                ids = b["doc_id"].iloc[part]
                yield pd.DataFrame({
                    "doc_id": ids.iloc[some].to_numpy(), "n": n[some],
                    "terms": [term[edge[d] : edge[d + 1]].tobytes() for d in some], "tf": [tf[edge[d] : edge[d + 1]].tobytes() for d in some], "stats": None,
                })
        yield pd.DataFrame({"doc_id": [None], "n": [0], "terms": [None], "tf": [None], "stats": [stats]})

    return run


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Score of entries: weight times the saturated count, in whole numbers."""
    tf = tf.astype(np.int64)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def length_marks(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms; products in whole numbers of any size."""
    values, of = np.unique(n, return_inverse=True)
    return np.array([75 + (25 * int(x) * docs) // terms for x in values], np.int64)[of]


def nra(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, k: int, bar: np.ndarray | None = None, step: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, entries read): the k best rows with a score above 0 that can still reach the bar, best first, ties by id.

    ``lists`` has, for each term, distinct rows by falling impact, their impacts, and how
    often the term counts. ``bar`` holds scores that the result will compete with.
    ``step`` entries of each list are read first.
    """
    n, m = len(ids), len(lists)
    low = np.zeros(n, np.int64)
    at, size = np.zeros(m, np.int64), np.array([len(d) for d, _, _ in lists], np.int64)
    high = np.array([int(x[0]) * times if len(x) else 0 for _, x, times in lists], np.int64)
    alive = np.ones(n, bool)
    read = 0
    others = np.zeros(0, np.int64) if bar is None else bar
    while True:
        for t in np.flatnonzero(at < size):
            docs, x, times = lists[t]
            to = min(at[t] + step, size[t])
            low[docs[at[t] : to]] += x[at[t] : to] * times
            read += int(to - at[t])
            at[t] = to
            high[t] = int(x[to]) * times if to < size[t] else 0
        step *= 2
        unseen = int(high.sum())  # upper score of a row that no list has shown
        scores = np.concatenate([others, low[alive] if unseen else low])
        kth = int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0
        if unseen >= max(kth, 1):
            continue
        known = np.zeros(n, np.int64)  # of the coming impacts, those of lists that have shown the row
        for t in np.flatnonzero(high):
            known[lists[t][0][: at[t]]] += high[t]
        upper = low + (unseen - known)
        alive &= (low > 0) & (upper >= kth)
        if not (upper[alive] > low[alive]).any():
            break
    rows = np.flatnonzero(alive)
    rows = rows[np.lexsort((ids[rows], -low[rows]))][:k]
    return rows, low[rows], read


class _Best:
    """The k best (doc_id, score) of one item so far."""

    def __init__(self) -> None:
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        s, i = np.concatenate([self.score, scores]), np.concatenate([self.id, ids])
        top = np.lexsort((i, -s))[:k]
        self.score, self.id = s[top], i[top]


def _blocks(batches: Iterator[pd.DataFrame], most: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Rows of batches, up to so many entries and documents together (or one document)."""
    held, entries, docs = [], 0, 0
    for b in batches:
        sizes = b["terms"].map(len).to_numpy() // 4
        at = 0
        while at < len(b):
            fits = int(np.searchsorted(np.cumsum(sizes[at:]), most[0] - entries, side="right"))
            take = max(min(fits, most[1] - docs, len(b) - at), 0 if held else 1)
            if take:
                held.append(b.iloc[at : at + take])
                entries, docs, at = entries + int(sizes[at : at + take].sum()), docs + take, at + take
            if at < len(b):
                yield pd.concat(held, ignore_index=True)
                held, entries, docs = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _search(items_path: str, weights_path: str, item_ids: list, docs: int, terms: int, k: int, most: tuple[int, int], step: int):
    """(item_id, doc_id, score): a task's k best documents of each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, w = mapped(items_path).view(np.int64), mapped(weights_path).view(np.int64)
        edges, rest = asked[: len(item_ids) + 1], asked[len(item_ids) + 1 :].reshape(2, -1)
        best = [_Best() for _ in item_ids]
        for b in _blocks(batches, most):
            count = b["terms"].map(len).to_numpy() // 4
            term = np.frombuffer(b"".join(b["terms"]), np.uint32).astype(np.int64)
            tf = np.frombuffer(b"".join(b["tf"]), np.uint32)
            doc = np.repeat(np.arange(len(b), dtype=np.int32), count)
            x = impacts(w[term], tf, length_marks(b["n"].to_numpy(), docs, terms)[doc])
            order = np.lexsort((-x, term))
            doc, x = doc[order], x[order]
            start = np.searchsorted(term[order], np.arange(len(w) + 1))
            ids = b["doc_id"].to_numpy(np.int64)
            for i, mine in enumerate(best):
                lists = [(doc[start[t] : start[t + 1]], x[start[t] : start[t + 1]], int(n)) for t, n in rest[:, edges[i] : edges[i + 1]].T if start[t] < start[t + 1]]
                if lists:
                    rows, scores, _ = nra(lists, ids, k, mine.score, step)
                    mine.add(ids[rows], scores, k)
        for item, mine in zip(item_ids, best):
            if len(mine.id):
                yield pd.DataFrame({"item_id": item, "doc_id": mine.id, "score": mine.score})

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of ``docs`` (doc_id, text) with the highest score above 0 for every row of ``items`` (item_id, text).

    Terms are runs of [0-9A-Za-z] and non-ASCII characters, A-Z lower-cased. A term's
    weight is floor(1000 * ln((2N + 2) / (2df + 1))), a document's m is
    75 + (25 * n * N) div L, and its score sums weight * ((1e9 * tf) div (1000 * tf + 12 * m))
    over the item's terms, repeats included. Equal scores go by doc_id. Null and empty
    texts have no terms and are never found; items without terms or item_id give no rows;
    of rows that share an item_id the smallest text asks. Documents that repeat a doc_id are each
    a candidate; those without doc_id rank after others of equal score. Texts are read
    whole, whatever their length; other columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    wanted = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    asked = materialize(wanted.mapInPandas(_asked, f"item_id {kind}, terms array<long>, times array<long>").where(F.size("terms") > 0), "asked")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), "text")
    found = None
    for block in range(blocks):  # one, unless items have more than BLOCK_TERMS terms together
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # a block of items
        if not rows:
            continue
        some = _block_search(texts, rows, kind, k)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "score")


def _block_search(texts: DataFrame, rows: list, kind: str, k: int) -> DataFrame:
    spark = texts.sparkSession
    terms = np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64)
    vocabulary = np.unique(terms)
    edges = np.cumsum([0] + [len(r["terms"]) for r in rows])
    times = np.concatenate([np.array(r["times"], np.int64) for r in rows])
    path = shared_path(spark, "asked")
    write_file(f"{path}/vocabulary", vocabulary.tobytes())
    write_file(f"{path}/items", np.concatenate([edges, np.searchsorted(vocabulary, terms), times]).astype(np.int64).tobytes())

    held = materialize(texts.mapInPandas(_entries(f"{path}/vocabulary"), "doc_id long, n long, terms binary, tf binary, stats array<long>"), "entries")
    parts = held.where("stats IS NOT NULL").select(F.posexplode("stats").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    stats = np.zeros(2 + len(vocabulary), np.int64)
    for r in parts.collect():  # one row for each term of the block
        stats[r["at"]] = r["x"]
    n, length = int(stats[0]), int(stats[1])
    write_file(f"{path}/weights", np.floor(1000 * np.log((2 * n + 2) / (2 * stats[2:] + 1))).astype(np.int64).tobytes())
    search = _search(f"{path}/items", f"{path}/weights", [r["item_id"] for r in rows], n, max(length, 1), k, (BLOCK_ENTRIES, BLOCK_DOCS), FIRST_READ)
    return materialize(held.where("stats IS NULL").select("doc_id", "n", "terms", "tf").mapInPandas(search, f"item_id {kind}, doc_id long, score long"), "ranked")


#: DuckDB SQL for k = 20.
RANKED_SQL = r"""
            WITH t AS (
              SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
            w AS (
              SELECT k, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM t),
            n AS (SELECT id, len(w) AS n FROM w WHERE k = 'd' AND len(w) > 0),
            s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
            q AS (SELECT id, x, count(*) AS times FROM (SELECT id, unnest(w) AS x FROM w WHERE k = 'b') GROUP BY id, x),
            f AS (
              SELECT id, x, count(*) AS tf FROM (SELECT id, unnest(w) AS x FROM w WHERE k = 'd')
              WHERE x IN (SELECT x FROM q) GROUP BY id, x),
            i AS (
              SELECT x, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
              FROM (SELECT x, count(*) AS df FROM f GROUP BY x), s),
            e AS (
              SELECT f.id, f.x, i.weight * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * n.n * s.docs) // s.total))) AS impact
              FROM f JOIN i USING (x) JOIN n ON n.id = f.id, s),
            r AS (
              SELECT q.id AS item_id, e.id AS doc_id, CAST(sum(q.times * e.impact) AS BIGINT) AS score
              FROM q JOIN e USING (x) GROUP BY q.id, e.id HAVING sum(q.times * e.impact) > 0)
            SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
            FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 20"""
