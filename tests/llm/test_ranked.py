"""Ranked search by NRA against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from brontide.llm import ranked as R

from .common import SCHEMA, ascii_lower, documents, prose, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    held = [(d, Counter(ascii_lower(x) for x in TERM.findall(t or ""))) for d, t, *_ in docs]
    some = [(d, c) for d, c in held if c]
    n, length, df = len(some), sum(sum(c.values()) for _, c in some), Counter(x for _, c in some for x in c)
    w = lambda x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
    out, texts = [], {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    for i, t in texts.items():
        asked = Counter(ascii_lower(x) for x in TERM.findall(t))
        scores = []
        for d, c in some:
            m = 75 + (25 * sum(c.values()) * n) // length
            s = sum(times * w(x) * ((1000000000 * c[x]) // (1000 * c[x] + 12 * m)) for x, times in asked.items() if c[x])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, prose(1, 20)), (2, "alpha alpha BETA gamma1"), (3, None), (4, ""), (5, "!!! ---"), (None, "alpha"), (6, "zeta"), (6, "alpha"), (7, prose(2, 60)), (8, "nowhere-to-be found"), (9, "ünïcode 東京 é"), (10, "word the quick q")]


@pytest.mark.parametrize("entries,docs_at_once,first", [(2_000_000, 1 << 16, 64), (40, 3, 1), (300, 7, 2)])
def test_ranks_equal_all_scores(spark, monkeypatch, entries, docs_at_once, first):
    monkeypatch.setattr(R, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(R, "BLOCK_DOCS", docs_at_once)
    monkeypatch.setattr(R, "FIRST_READ", first)
    data = [*documents(), *[(500 + i, prose(1, 120), None, None, None) for i in range(9)]]  # ties over the k-th place
    df, items = with_clashes(spark.createDataFrame(data, SCHEMA)).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")
    for k in (1, 20):
        assert rows(R.ranked_search(df, items, k)) == plain(data, ITEMS, k)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_TERMS", 15)
    df, items = spark.createDataFrame(documents(), SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows(R.ranked_search(df, items, 5)) == plain(documents(), ITEMS, 5)


def test_empty_tables_and_texts(spark):
    df, items = spark.createDataFrame(documents(), SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    for a, b in ((df.limit(0), items), (df, items.limit(0)), (df.where("text IS NULL"), items), (df, items.where("text IS NULL"))):
        got = R.ranked_search(a, b)
        assert rows(got) == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_stops_before_the_ends_of_lists():
    """Scores are exact, and a bar from earlier blocks saves most reads."""
    r = np.random.default_rng(1)
    n = 5000
    for seed in range(6):
        lists = []
        for _ in range(6):
            docs = r.permutation(n)[: r.integers(50, n)].astype(np.int32)
            x = (r.integers(1000, 10_000) * 100 // np.arange(1, len(docs) + 1) + 1).astype(np.int64)
            lists.append((docs, x, int(r.integers(1, 4))))
        score = np.zeros(n, np.int64)
        for docs, x, times in lists:
            score[docs] += x * times
        ids = r.permutation(n) * 3
        order = np.lexsort((ids, -score))
        order = order[score[order] > 0][:10]
        rows_, scores, read = R.nra(lists, ids, 10)
        assert rows_.tolist() == order.tolist() and scores.tolist() == score[order].tolist()
        high = np.full(10, 2 * score.max(), np.int64)
        _, none, few = R.nra(lists, ids, 10, high)
        assert few < 0.2 * sum(len(d) for d, _, _ in lists) and few <= read
        bar = score[order][:5]
        got, with_bar, _ = R.nra(lists, ids, 10, bar)
        better = [i for i in order if score[i] > 0][: len(got)]
        assert set(order[:5].tolist()) <= set(got.tolist()) and with_bar.tolist() == score[better].tolist()


def test_length_marks_of_any_size():
    big = R.length_marks(np.array([10**7, 3, 10**7]), 5 * 10**10, 10**13)
    assert big.tolist() == [75 + 25 * 10**7 * 5 * 10**10 // 10**13, 75 + 25 * 3 * 5 * 10**10 // 10**13, 75 + 25 * 10**7 * 5 * 10**10 // 10**13]


def test_a_long_text(spark):
    r = random.Random(3)
    long = " ".join(r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(400_000))
    data = [(1, long, None, None, None), (2, "aa bb cc", None, None, None), (3, "x" * 300_000, None, None, None)]
    items = [(1, "aa bb"), (2, "x" * 300_000)]
    got = R.ranked_search(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == plain(data, items, 20)
