"""Repeated word sequences by recompression against a table of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brontide.llm import substrings as S
from brontide.llm.shared import word_hashes

from .common import SCHEMA, documents, prose, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(data, window, key_of):
    """Rows of one doc_id and text are one document; the others of a doc_id come by the hash of their text."""
    docs = {}
    for d, t, *_ in data:
        t = t or ""
        docs[(d is None, d or 0, key_of[t], t)] = WORD.findall(t)
    first, gone = {}, {}
    for name in sorted(docs):
        w = docs[name]
        gone[name] = set()
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), (name, i)) != (name, i):
                gone[name] |= set(range(i, i + window))
    out = []
    for d, t, *_ in data:
        name = (d is None, d or 0, key_of[t or ""], t or "")
        kept = " ".join(x for i, x in enumerate(docs[name]) if i not in gone[name])
        out.append((d, len(docs[name]), len(gone[name]), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def keys(spark, data):
    texts = sorted({t or "" for _, t, *_ in data})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r["t"]: r["k"] for r in df.select("t", F.xxhash64("t").alias("k")).collect()}


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()), key=repr)


def odd_documents():
    a, b = prose(31, 80), prose(32, 50)
    r = random.Random(2)
    texts = [a + " " + b, "x " + b + " y", b, "word " * 90, "word " * 300 + "end", " ".join(["!!!", "###", "$$$"] * 40), "start " + " ".join(["###", "$$$", "!!!"] * 30), a.replace(" ", "\t\n "), b + " " + b]
    texts += [" ".join(r.choice("ab") for _ in range(300)), " ".join(r.choice("ab") for _ in range(300)), " ".join(r.choice("abc") for _ in range(40))]
    data = [(1000 - 3 * i, t, None, None, None) for i, t in enumerate(texts)]
    return [*documents(), *data, (1000, texts[1], None, None, None), data[2], data[2], (None, b, None, None, None), (None, a, None, None, None), (None, b, None, None, None), (2**60 + 1, b, None, None, None), (2**60, a, None, None, None)]


@pytest.mark.parametrize("window,slice_chars", [(20, 3_000_000), (20, 400), (7, 1500), (3, 700), (1, 900)])
def test_removed_words_equal_a_table_of_windows(spark, monkeypatch, window, slice_chars):
    """Texts in slices, homes and shards of many sizes."""
    monkeypatch.setattr(S, "SLICE_CHARS", slice_chars)
    monkeypatch.setattr(S, "HOME_CHARS", 3 * slice_chars)
    monkeypatch.setattr(S, "SHARD_CHARS", 2000)
    data = odd_documents()
    random.Random(window).shuffle(data)
    df = with_clashes(spark.createDataFrame(data, SCHEMA)).repartition(3)
    assert rows(S.repeated_substrings(df, window, texts=True)) == plain(data, window, keys(spark, data))


def test_empty_tables_and_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \t\n"), (None, None)], "doc_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert rows(S.repeated_substrings(df, texts=True)) == sorted([(i, 0, 0, none, "") for i in (1, 2, 3, None)], key=repr)
    assert S.repeated_substrings(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        S.repeated_substrings(df, 0)


def test_a_long_text_that_repeats_within_itself(spark):
    r = random.Random(7)
    part = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    data = [(1, part + " middle " + part, None, None, None), (2, "q" * 200_000 + " " + part[: len(part) // 2], None, None, None)]
    assert rows(S.repeated_substrings(spark.createDataFrame(data, SCHEMA), texts=True)) == plain(data, 20, keys(spark, data))


def renamed(words, ways):
    h, at = word_hashes([" ".join(words).encode()])
    return S.renamed(h, at, ways), at


def test_equal_sequences_have_equal_symbols_inside():
    """Whatever stands around, the symbols whose stretch lies inside a sequence are the same, and they tell all windows that are not repeated."""
    r = random.Random(3)
    ways = [S._way(i, i % S.SIDES) for i in range(S.ROUNDS.count("p"))]
    for _ in range(60):
        n = r.choice([20, 25, 60])
        same = [r.choice("abcdefghij"[: r.choice([2, 4, 10])]) for _ in range(n)]
        seen = []
        for _ in range(2):
            left, right = ([r.choice("abcdefghij") for _ in range(r.randrange(12))] for _ in range(2))
            s, at = renamed([*left, *same, *right], ways)
            inside = (s.since >= len(left)) & (s.until <= len(left) + n)
            seen.append([(int(x), int(a) - len(left), int(b) - len(left)) for x, a, b in zip(s.name[inside], s.since[inside], s.until[inside])])
        assert seen[0] == seen[1]


def test_most_windows_of_plain_text_hold_a_symbol():
    words = [f"w{random.Random(i).randrange(5000)}" for i in range(4000)]
    s, at = renamed(words, [S._way(i, 0) for i in range(S.ROUNDS.count("p"))])
    name, first, last = S.provable(s, at, 20)
    held = np.zeros(len(words) + 1, int)
    np.add.at(held, first, 1)
    np.add.at(held, last + 1, -1)
    assert (np.cumsum(held)[: len(words) - 19] > 0).mean() > 0.9 and len(name) < 0.45 * len(words)


def test_runs_and_pairs():
    h = np.array([5, 5, 5, 9, 5, 5], np.uint64)
    s = S.name_runs(S.words_as_symbols(h, np.array([0, 4, 6])))
    assert s.text.tolist() == [0, 0, 1] and s.name[1] == 9 and len({*s.name.tolist()}) == 3  # runs of three and of two differ
    far = S._FAR
    assert s.since.tolist() == [-far, 2, -far] and s.until.tolist() == [4, far, far]
    empty = S.words_as_symbols(np.zeros(0, np.uint64), np.array([0]))
    assert len(S.name_runs(empty).name) == len(S.name_pairs(empty, 1).name) == S.pairs_joined(empty, 1) == 0
