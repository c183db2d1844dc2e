import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from brontide.llm import decontaminate, licenses, mixing, near_dups, ngram_lm, privacy, quality, token_counts, token_files, topk
from brontide.llm.components import connected_components
from brontide.llm.shared import word_spans

from .common import SCHEMA, SPACE_WORD, ascii_lower, documents, edited, prose, with_clashes

SCHEMA_B = "item_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return with_clashes(spark.createDataFrame(documents(), SCHEMA).repartition(3)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


# --- shared -----------------------------------------------------------------------
def test_word_spans_equal_split_also_across_pieces(monkeypatch):
    from brontide.llm import shared

    texts = [b"", b"  ", b"one", b" a b\tc\x0bd ", b"x" * 500, b"ab " * 400, b"q"]
    whole = word_spans(texts)
    assert [int(n) for n in np.diff(whole[1])] == [len(t.split()) for t in texts]
    for i, t in enumerate(texts):
        s = slice(whole[1][i], whole[1][i + 1])
        assert [t[a:b] for a, b in zip(whole[2][s], whole[3][s])] == t.split()
    monkeypatch.setattr(shared, "PIECE_BYTES", 100)
    for a, b in zip(whole, word_spans(texts)):
        assert (a == b).all()


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(3, 3), (None, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = sorted((n, root(n)) for n in parent)
    got = sorted(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == want


# --- 1 ---------------------------------------------------------------------------
def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    r = np.random.default_rng(3)
    data = [(i, [float(x) for x in r.normal(size=16)]) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(30)] + [(400, None), (500, [None] + [1.0] * 15), (600, [float("nan")] * 16), (700, [float("inf")] * 16), (800, [0.5, -0.5]), (900, [0.0] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in ints:
        if q % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q)[:10]
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert rows(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(df.limit(0)).collect() == []
    few = topk.top_k(df.where("vec_id IN (0, 5, 9)"))
    assert few.count() == 2


def test_topk_of_clashing_columns_and_large_components(spark):
    data = [(i, [float(i % 7), 1e3 * i, -3.25]) for i in range(0, 300, 20)] + [(100, [0.0, 0.0, 0.0])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit(7) for c in ("v", "d", "block", "q_block", "score", "rank", "query_id")})
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in data]
    want = []
    for q, v in ((0, ints[0][1]), (100, min(v for i, v in ints if i == 100)), (200, ints[10][1])):
        s = sorted((-sum(a * b for a, b in zip(v, y)), i) for i, y in ints if i != q)[:10]
        want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert rows(topk.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_topk_stops_early_on_clustered_vectors():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(-20, 20, (2000, 8)), r.integers(-20, 20, (60, 8)) + 4000])
    pivots = topk.pick_pivots(x)
    d = topk._distances(x, pivots)
    got, products = topk.search_block(np.arange(len(x)), x, d, np.array([2000]), x[2000:2001], d[2000:2001], 10)
    s = x @ x[2000]
    s[2000] = -(1 << 60)
    want = np.lexsort((np.arange(len(x)), -s))[:10]
    assert got["vec_id"].tolist() == want.tolist() and products < 400


# --- 2 ---------------------------------------------------------------------------
def shares(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return target


def test_mixing_meets_targets_and_reruns_agree(spark, docs, empty):
    got = mixing.taken_words(docs, block_words=16).collect()
    data = documents()
    assert len(got) == len(data)
    sizes = Counter()
    for _, t, _, s, _ in data:
        sizes[s] += len(SPACE_WORD.findall(t or ""))
    want = shares(sizes)
    of = {(d, len(SPACE_WORD.findall(t or ""))): s for d, t, _, s, _ in data}
    taken = Counter()
    for r in got:
        s = of[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    assert sorted(map(tuple, got), key=repr) == rows(mixing.taken_words(docs.repartition(5), block_words=16), "doc_id", "size", "source_size", "target", "taken")
    assert mixing.taken_words(empty).collect() == []


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 257):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k"), 9)).collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def test_mixed_documents_hold_what_is_taken(spark, docs):
    plan = {(r["doc_id"], r["size"]): 0 for r in mixing.taken_words(docs, block_words=16).collect()}
    for r in mixing.taken_words(docs, block_words=16).collect():
        plan[r["doc_id"], r["size"]] += r["taken"]
    out = mixing.mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    words = {(d, len(SPACE_WORD.findall(t or ""))): set(SPACE_WORD.findall(t or "")) for d, t, *_ in documents()}
    total, by = 0, Counter()
    for r in out.collect():
        w = SPACE_WORD.findall(r["text"])
        total += len(w)
        by[r["doc_id"]] += len(w)
        assert r["n_chars"] == len(r["text"]) and any(d == r["doc_id"] and set(w) <= x for (d, _), x in words.items())
    assert total == sum(plan.values())
    wanted = Counter()
    for (d, _), n in plan.items():
        wanted[d] += n
    assert {d: n for d, n in wanted.items() if n} == dict(by)


def test_shard_counts_follow_the_multinomial_law(spark):
    """Counts of 400 shards of 100 slots: means n p, variances n p (1 - p), covariances -n p q, whole shards and whole totals."""
    quota = {"a": 22000, "b": 12000, "c": 6000}
    first, rows_ = 0, []
    for s, n in quota.items():
        rows_.append((s, first, n))
        first += n
    got = mixing.shard_counts(spark.createDataFrame(rows_, "source_key string, _first long, _count long"), 5, 100).collect()
    count = np.zeros((400, 3))
    for r in got:
        count[r["shard"], "abc".index(r["source_key"])] += r["n"]
    p = np.array([0.55, 0.3, 0.15])
    assert (count.sum(1) == 100).all()
    assert np.abs(count.mean(0) - 100 * p).max() < 4 * np.sqrt(100 * 0.25 / 400)
    want = 100 * (np.diag(p) - np.outer(p, p))
    assert np.abs(np.cov(count.T) - want).max() < 0.25 * want.max()


def test_slots_meet_their_quotas_and_shards_keep_what_was_drawn(spark, docs):
    """Every (shard, slot) once, every source's words to the word, and counts a shard within what was moved."""
    _, slots, _ = mixing.mix_plan(docs, block_words=4)
    got = slots.collect()
    places = sorted((r["shard"], r["slot"]) for r in got)
    assert places == [(i // mixing.SHARD_SLOTS, i % mixing.SHARD_SLOTS) for i in range(len(got))]
    assert len({(r["source_key"], r["block"]) for r in got}) < len(got)
    words = Counter()
    for r in got:
        words[r["source_key"]] += r["words"]
    sizes = Counter()
    for _, t, _, s, _ in documents():
        sizes[s] += len(SPACE_WORD.findall(t or ""))
    want = shares(sizes)
    assert {k: n for k, n in words.items()} == {"n" if s is None else "s" + s: round(x) for s, x in want.items() if round(x)}


def test_prefix_sums(spark, monkeypatch):
    from brontide.llm import shared

    monkeypatch.setattr(shared, "PREFIX_RUN", 4)
    r = random.Random(2)
    data = [(k, i, r.randrange(9)) for k in "ab" for i in range(30) if r.random() < 0.6]
    got = shared.prefix_sums(spark.createDataFrame(data, "k string, i long, v long"), "k", "i", "v", "s")
    assert rows(got, "k", "i", "v", "s") == sorted(((k, i, v, sum(y for a, j, y in data if a == k and j < i)) for k, i, v in data), key=repr)


# --- 3 ---------------------------------------------------------------------------
def test_license_scan(spark, docs):
    a, b = licenses.TEMPLATES["MIT"], "Released under the MIT License."
    texts = [(1, f"ünï head\n{a}\ntail"), (2, a.replace("publish", "print").replace("sublicense, ", "")), (3, "x " * 50 + b + " y " * 9 + b), (4, None), (5, ""), (6, prose(3, 200)), (7, "released under the terms of no license")]
    got = licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    mit = {r["doc_id"]: r for r in got if r["license"] == "MIT"}
    assert set(mit) == {1, 2} and mit[1]["coverage"] == 1.0 and 0.9 < mit[2]["coverage"] < 1.0
    assert texts[0][1][mit[1]["start"] : mit[1]["end"]] == a.rstrip(".")
    spans = [texts[2][1][r["start"] : r["end"]] for r in got if r["doc_id"] == 3 and r["license"] == "MIT-notice"]
    assert spans == [b.rstrip(".")] * 2
    assert not [r for r in got if r["doc_id"] in (4, 5, 6, 7)]
    assert licenses.license_scan(docs.limit(0)).collect() == []


def test_license_scan_of_odd_tables(spark, docs):
    """Clashing columns, rows that repeat or lack an id, ties of two templates, and a text of two million characters."""
    same = {"one": "alpha beta gamma delta epsilon", "two": "alpha beta gamma delta epsilon", "far": "omega omega omega one two three"}
    filler = "münze " * 330_000
    texts = [(1, "x alpha beta gamma delta epsilon y"), (1, "x alpha beta gamma delta epsilon y"), (None, "alpha beta gamma delta epsilon"), (2, filler + "alpha beta gamma delta epsilon. " + filler), (3, None)]
    df = with_clashes(spark.createDataFrame(texts, "doc_id long, text string"))
    got = rows(licenses.license_scan(df, same), "doc_id", "license", "matched", "start", "end")
    at = len(filler)
    want = [(1, n, 5, 2, 32) for n in ("one", "two")] * 2 + [(None, n, 5, 0, 30) for n in ("one", "two")] + [(2, n, 5, at, at + 30) for n in ("one", "two")]
    assert got == sorted(want, key=repr)
    assert licenses.license_scan(docs, {}).collect() == []


def longest_common(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_license_scan_finds_what_brute_force_finds(spark):
    """Edited and whole copies of templates in prose: a report for each that still holds a run of fingerprints, none elsewhere, matches as counted by brute force."""
    r = random.Random(31)
    vocabulary = [f"w{i}" for i in range(400)]
    templates = {f"t{i}": " ".join(r.choice(vocabulary) for _ in range(40)) for i in range(5)}
    texts, want = [], {}
    for d in range(60):
        words = [f"p{r.randrange(900)}" for _ in range(60)]
        if d % 3:
            name = f"t{r.randrange(5)}"
            copy = templates[name].split()
            for i in r.sample(range(40), d % 7):
                copy[i] = f"edit{i}"
            words[20:20] = copy
            want[d] = (name, longest_common(templates[name].split(), copy))
        texts.append((d, " ".join(words)))
    got = {x["doc_id"]: (x["license"], x["matched"]) for x in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string"), templates).collect()}
    assert got == want


@pytest.mark.parametrize("gap", range(14))
def test_every_notice_of_a_run_is_found(gap):
    """Whole notices any number of words apart, also beside notices of four of their five words."""
    index = licenses.Index.of(licenses.TEMPLATES)
    whole, part = "released under the mit license".split(), "released under the mit".split()
    for notices in ([whole] * 9, [part, whole, part, part, whole]):
        words, spans = ["start"], []
        for w in notices:
            spans.append((len(w), len(words), len(words) + len(w)))
            words += w + [f"gap{i}" for i in range(gap)]
        h = word_spans([" ".join(words).encode()])[0]
        got = [r[1:] for r in licenses.scan_text(h, index, 0.8) if index.names[r[0]] == "MIT-notice"]
        assert sorted(got, key=lambda r: r[1]) == spans


def test_stretches_apart_match_most_words_of_all():
    """Beside every choice of stretches without overlap, by brute force."""
    r = random.Random(8)
    for _ in range(20):
        t = np.array([r.randrange(4) for _ in range(5)], np.uint64)
        d = np.array([r.randrange(4) for _ in range(14)], np.uint64)
        best = [0] * 15
        for e in range(1, 15):
            best[e] = best[e - 1]
            for a in range(e):
                m = [[0] * (e - a + 1) for _ in range(6)]
                for i in range(5):
                    for j in range(e - a):
                        m[i + 1][j + 1] = m[i][j] + 1 if t[i] == d[a + j] else max(m[i][j + 1], m[i + 1][j])
                if m[5][-1] >= 4:
                    best[e] = max(best[e], best[a] + m[5][-1])
        got = licenses.apart(set(licenses.stretches(t, d, 0, 4, 20)))
        assert sum(m for _, _, m in got) == best[14] and all(x[0] <= y[1] for x, y in zip(got, got[1:]))


def test_banded_alignment_is_the_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(30):
        t = np.array([r.randrange(6) for _ in range(12)], np.uint64)
        d = np.array([r.randrange(6) for _ in range(16)], np.uint64)
        m = [[0] * 17 for _ in range(13)]
        for i in range(12):
            for j in range(16):
                m[i + 1][j + 1] = m[i][j] + 1 if t[i] == d[j] else max(m[i][j + 1], m[i + 1][j])
        assert licenses.align(t, d, 0, 20)[0] == m[12][16]


# --- 4 ---------------------------------------------------------------------------
def components(data, k, percent):
    sets, by = {}, {}
    for d, t, *_ in data:
        w = [ascii_lower(x) for x in SPACE_WORD.findall(t or "")]
        sh = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(sh)
    ids = [d for d in sets if d is not None]
    comp = {d: d for d in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                comp[max(p, q)] = min(p, q)
    return sorted(((d, len(sh), None if d is None else root(d), None if d is None else d == root(d)) for d, s in sets.items() for sh in s), key=repr)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, docs, empty, k, monkeypatch):
    monkeypatch.setattr(near_dups, "SMALL_RUN", 3)
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    got = rows(near_dups.near_duplicates(docs, k), "doc_id", "n_shingles", "component_id", "kept")
    assert got == components(documents(), k, 80)
    assert near_dups.near_duplicates(empty, k).collect() == []


@pytest.mark.parametrize("text", ["one two", "one two three"])
@pytest.mark.parametrize("k", [4, 5])
def test_a_slice_of_fewer_words_than_a_shingle(spark, text, k):
    """The only text of a table, and one that stands alone before a text as large as a slice."""
    ((_, alone, at),) = near_dups.shingle_sets([text], k)
    _, beside, _ = next(near_dups.shingle_sets([text, prose(4, 50)], k))
    assert at.tolist() == [0, 1] and alone[0] == beside[0]
    assert [len(s) for _, s, _ in near_dups.shingle_sets([text, "word " * 420_000], k)] == [1, 1]
    got = rows(near_dups.near_duplicates(spark.createDataFrame([(3, text)], "doc_id long, text string"), k), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [(3, 1, 3, True)]


def test_links_between_components_of_one_bucket_are_found(spark):
    """A chain in which neighbours link and others do not, besides many copies of its middle."""
    base = prose(9, 200)
    chain = [base]
    for i in range(12):
        chain.append(edited(chain[-1], i, 100))
    data = [(i, t, None, None, None) for i, t in enumerate(chain)] + [(100 + i, chain[6], None, None, None) for i in range(40)]
    random.Random(1).shuffle(data)
    got = rows(near_dups.near_duplicates(spark.createDataFrame(data, SCHEMA), 4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == components(data, 4, 80)


def test_pairs_that_share_a_key_are_checked_on_their_sets_at_any_distance():
    """Signatures that agree in one chunk alone; 8 of 10 shingles shared is a link, 7 of 10 is none."""
    one = np.arange(near_dups.SYMBOLS, dtype=np.uint16)
    other = one + np.uint16(100)
    other[: near_dups.PER_CHUNK] = one[: near_dups.PER_CHUNK]
    rest = {"key": 1 << 48, "i": 0, "j": 0, "block": 0}
    for shared, links in ((8, [(1, 2)]), (7, [])):
        sets = [np.arange(9), np.r_[np.arange(shared), 100 : 109 - shared]]
        frame = pd.DataFrame([{**rest, "node": n, "component": n, "sig": sig.tobytes(), "shingles": s} for n, sig, s in zip((1, 2), (one, other), sets)])
        assert [tuple(r) for out in near_dups._links(80)(iter([frame])) for r in out.to_numpy().tolist()] == links


def test_without_near_duplicates_keeps_one_each(spark, docs):
    out = near_dups.without_near_duplicates(docs, 5)
    assert out.columns == docs.columns
    keep = {r[0] for r in components(documents(), 5, 80) if r[3]}
    assert sorted(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect()) == sorted(keep)
    assert [r["text"] for r in out.where("doc_id IS NULL").collect()] == [None]  # the other one is a copy of document 0


def test_near_duplicates_of_ids_that_are_strings(spark):
    data = [(f"d{d:03d}" if d is not None else None, t, *rest) for d, t, *rest in documents()]
    df = spark.createDataFrame(data, SCHEMA.replace("doc_id long", "doc_id string"))
    got = rows(near_dups.near_duplicates(df, 4), "doc_id", "n_shingles", "component_id", "kept")
    assert got == components(data, 4, 80)
    out = near_dups.without_near_duplicates(df, 5)
    assert {r["doc_id"] for r in out.collect()} == {r[0] for r in components(data, 5, 80) if r[3]} | {None}


def test_rows_without_id_are_judged_by_their_text(spark):
    """They stay only where no row with an id and no equal row is kept, and never with a passage of the benchmark."""
    base, other, leak = prose(71, 80), prose(72, 80), prose(73, 40)
    data = [(5, base), (None, edited(base, 1, 80)), (None, other), (None, other), (None, edited(other, 2, 80)), (None, ""), (None, None), (None, "pre " + leak + " post"), (6, leak)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = near_dups.without_near_duplicates(df, 5)
    assert sorted(repr(r["text"]) for r in out.where("doc_id IS NULL").collect() if r["text"] is None or not r["text"].strip()) == ["''", "None"]
    kept = [r["text"] for r in out.where("doc_id IS NULL").collect() if r["text"]]
    assert len([t for t in kept if components([(1, t), (2, other)], 5, 80)[1][3] is False]) == 1 and len(kept) == 1
    clean = decontaminate.decontaminated(df, spark.createDataFrame([(1, leak)], SCHEMA_B))
    assert [t for _, t in data[:7]] == [r["text"] for r in clean.collect()] or sorted(map(repr, (r["text"] for r in clean.collect()))) == sorted(repr(t) for _, t in data[:7])


# --- 5 ---------------------------------------------------------------------------
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PII = [
    "mail a.b+c@x-y.co.uk, d@e.f_g@h.ii and no@domain or @x.y", "é ip 10.0.0.1 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 0000255.01.1.2", "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500-0000-0000-0004 7",
    "call +49 (30) 123-456-78 or +1 2 or +123456789012345678 x +44.20.7946.0958.", "日本 +81 3 1234 5678 foo@bar.example 192.168.1.254", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0", "9" * 5000, "a@b.c" + ".d" * 3000, "", None, "x" * 3000 + "@y.z",
]


def test_base_spans_equal_brute_force(spark):
    data = [(i, t) for i, t in enumerate(PII)] + [(0, PII[0]), (None, PII[4])]
    for r in privacy.personal_data(with_clashes(spark.createDataFrame(data, "doc_id long, text string"))).collect():
        want = base_spans(dict(data)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert r["spans"] == ",".join(want)
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]


def test_random_texts_equal_brute_force(spark):
    r = random.Random(4)
    data = [(i, "".join(r.choice("01 9-.+()@a_é,5\n") for _ in range(400))) for i in range(60)]
    for x in privacy.personal_data(spark.createDataFrame(data, "doc_id long, text string")).collect():
        assert x["base_sha256"] == hashlib.sha256(",".join(base_spans(data[x["doc_id"]][1])).encode()).hexdigest()


def test_disclosing_terms_are_found_and_replaced(spark):
    data = [(i, f"memo {i} the zorblax project of boss@corp.example item{i} in town") for i in range(6)]
    data += [(10 + i, prose(i, 30) + " the town") for i in range(60)] + [(90, "who runs zorblax today"), (91, None)]
    df = with_clashes(spark.createDataFrame(data, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in privacy.personal_data(df).collect()}
    at = data[-2][1].index("zorblax")
    assert got[90]["spans"] == f"removed:{at}:{at + 7}" and got[90]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all("removed" not in got[10 + i]["spans"] for i in range(60)) and got[91]["spans"] == ""
    out = {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}
    assert out[90] == "who runs  today" and "[EMAIL]" in out[0] and "boss" not in out[0] and out[10] == data[6][1] and out[91] is None


def brute_terms(data, near=privacy.CONTEXT):
    """Terms and shares by the module's definition, counted in documents."""
    n, words, ne, nte, contexts = len(data), Counter(), Counter(), Counter(), {}
    for _, t in data:
        t = t or ""
        words.update({w.lower() for w in SPACE_WORD.findall(t)})
        mine = {}
        for span in base_spans(t):
            kind, a, b = span.split(":")
            a, b = int(a), int(b)
            left, right = t[max(0, a - near - 1) : a], t[b : b + near + 1]
            if a > near:
                left = re.sub(r"^[^\x20\x09-\x0D]+", "", left)
            if len(right) > near:
                right = re.sub(r"[^\x20\x09-\x0D]+\Z", "", right)
            by = sorted(w.lower() for w in SPACE_WORD.findall(left + " " + right) if re.search(r"[^\W\d_]", w))
            mine.setdefault((kind, t[a:b]), set()).update(by)
            contexts.setdefault((kind, t[a:b]), set()).add(tuple(by))
        ne.update(mine.keys())
        nte.update((e, w) for e, by in mine.items() for w in by)
    best = {}
    for (e, w), c in nte.items():
        if sum(w in x for x in contexts[e]) >= 3:
            content = math.log2(n / ne[e])
            best[w] = max(best.get(w, 0.0), math.log2(c * n / (words[w] * ne[e])) / content if content > 0 else 0.0)
    return {w: s for w, s in best.items() if s >= 0.5}


def test_disclosing_terms_equal_brute_force(spark):
    r = random.Random(12)
    people = [f"p{i}@corp{i % 3}.example" for i in range(6)]
    data = []
    for i in range(160):
        t = prose(1000 + i, 30)
        for _ in range(r.randrange(3)):
            who = r.randrange(6)
            t += f" {r.choice(['Desk', 'near', 'by'])} room{who} {people[who]} (Team-{who % 3}) " + prose(r.randrange(9), 6)
        data.append((i, t))
    data += [(200 + i, data[5][1]) for i in range(8)] + [(300, None), (301, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_terms(data)
    assert any(s >= 0.8 for s in want.values()) and any(s < 0.8 for s in want.values())
    expect = {}
    for d, t in data:
        spans = [(s.split(":")[0], int(s.split(":")[1]), int(s.split(":")[2])) for s in base_spans(t or "")]
        more = sorted((want[m[0].lower()] < 0.8, m.start(), m.end()) for m in SPACE_WORD.finditer(t or "") if m[0].lower() in want)
        expect[d] = ",".join([f"{k}:{a}:{b}" for k, a, b in spans] + [f"{'generalised' if g else 'removed'}:{a}:{b}" for g, a, b in more])
    assert {r["doc_id"]: r["spans"] for r in privacy.personal_data(df).collect()} == expect


def test_privacy_of_empty_tables_and_rows_without_id(spark, empty):
    assert privacy.personal_data(empty).collect() == [] and privacy.sanitised(empty).collect() == []
    two = spark.createDataFrame([(None, "a@b.example"), (None, None), (None, "a@b.example")], "doc_id long, text string")
    assert sorted(r["spans"] for r in privacy.personal_data(two).collect()) == ["", "email:0:11", "email:0:11"]
    assert sorted(map(repr, (r["text"] for r in privacy.sanitised(two).collect()))) == ["'[EMAIL]'", "'[EMAIL]'", "None"]


def test_privacy_of_very_long_texts(spark):
    """100,000 addresses in one text, a blob of a million letters beside an address, and a million words."""
    logs = " ".join(f"10.{i // 65536 % 256}.{i // 256 % 256}.{i % 256}" for i in range(100_000))
    blob = "Q" * 1_000_000 + " a@b.example " + "7" * 300_000 + ".1"
    data = [(1, logs), (2, blob), (3, "x y " * 500_000 + "c@d.example")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in privacy.personal_data(df).collect()}
    assert [got[i]["n_ip"] for i in (1, 2, 3)] == [100_000, 0, 0] and [got[i]["n_email"] for i in (1, 2, 3)] == [0, 1, 1]
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(base_spans(logs)).encode()).hexdigest()
    out = {r["doc_id"]: r["text"] for r in privacy.sanitised(df).collect()}
    assert out[1] == " ".join(["[IP]"] * 100_000) and out[2] == blob.replace("a@b.example", "[EMAIL]") and out[3].endswith("x y [EMAIL]")


def test_regions_of_overlapping_spans_are_replaced_whole(spark):
    text = "t " * 600 + "id 10.0.0.1@host.example and +4915112345678@x.example " + "u " * 600
    got = privacy.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert got == "t " * 600 + "id [EMAIL] and [EMAIL] " + "u " * 600


def test_words_at_the_edges_of_a_context_count_if_they_are_whole(spark):
    """First and last words of texts, words that end with the 80 characters, and words that these cut."""
    fill = lambda i, n: f"{'-' * (n - 5)} n{i} "
    data = [(i, f"firstly n{i} a@x.example n{i} lastly") for i in range(4)] + [(10 + i, f"u wholly {fill(i, 74)}b@x.example {fill(i, 74)}entire u") for i in range(4)]
    data += [(20 + i, f"u prefix {fill(i, 75)}c@x.example {fill(i, 75)}suffix u") for i in range(4)] + [(30 + i, prose(i, 20)) for i in range(60)]
    probes = {"firstly": True, "lastly": True, "wholly": True, "entire": True, "prefix": False, "refix": False, "suffix": False, "suffi": False}
    data += [(100 + i, f"see {w} here") for i, w in enumerate(probes)]
    got = {r["doc_id"]: r["spans"] for r in privacy.personal_data(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert {w: got[100 + i] for i, w in enumerate(probes)} == {w: f"removed:4:{4 + len(w)}" if yes else "" for w, yes in probes.items()}


# --- 6 ---------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["predicted"] for r in good) / len(good) > 0.97
    assert sum(1 - r["predicted"] for r in bad) / len(bad) > 0.7
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_quality_odd_cases(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (6, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels)
    assert got.count() == len(documents()) and got.where("score IS NULL OR isnan(score)").count() == 0
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(empty, labels).collect() == []
    kept = quality.good_documents(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(documents())


def plain_features(text):
    b = (text or "").encode()
    if not b:
        return [0.0] * len(quality.FEATURES)
    groups = ["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!?", "|", "#$%&*+=~^_@\\/<>", "'\"()[]{}-`"]
    of = lambda x: next((i for i, g in enumerate(groups) if chr(x) in g), 0)
    w, lines, n = re.findall(rb"[^ \t\n\x0b\x0c\r]+", b), b.split(b"\n"), len(b)
    k = max(len(w), 1)
    rows_ = [sum(of(x) == c for x in b) / n for c in range(12)]
    rows_ += [math.log1p(n), math.log1p(len(w)), sum(map(len, w)) / k, len(set(w)) / k, len(set(zip(w, w[1:]))) / max(len(w) - 1, 1), len(set(zip(w, w[1:], w[2:]))) / max(len(w) - 2, 1)]
    rows_ += [sum(x == y for x, y in zip(w, w[1:])) / k, n / len(lines), len(set(lines)) / len(lines), sum(of(x[-1]) in (8, 10) for x in w) / k, len(w) / (b.count(b".") + 1), sum(len(x) <= 2 for x in w) / k, sum(len(x) >= 16 for x in w) / k]
    return rows_


def test_features_equal_a_plain_reading(monkeypatch):
    from brontide.llm import shared

    monkeypatch.setattr(shared, "PIECE_BYTES", 700)
    r = random.Random(14)
    texts = [None, "", " ", "a", "a a a", "one\ntwo\n\ntwo", "x" * 40 + "! ümläut. 東京 a|b #", prose(3, 400)] + ["".join(r.choice("aAbé1 .,!?|#'\n\t ") for _ in range(r.randrange(90))) for _ in range(60)]
    want = np.array([plain_features(t) for t in texts])
    assert np.allclose(quality.features(texts), want, rtol=1e-5, atol=1e-6)


def test_flat_trees_equal_a_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    m = quality.fit_trees(x, y, trees=20)
    for i in range(0, 500, 50):
        total = m.start
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[i, f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert m.scores(x[i : i + 1])[0] == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((m.scores(x) > 0.5) == y).mean() > 0.95


# --- 7 ---------------------------------------------------------------------------
WORD7 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, bench):
    items = [(i, WORD7.findall(ascii_lower(t or ""))) for i, t in bench if i is not None]
    windows = {}
    for i, w in items:
        n = min(10, len(w))
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t, *_ in docs:
        w = WORD7.findall(ascii_lower(t or ""))
        hit, found = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= x
        ids = ",".join(sorted(str(i) for i in found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark, docs, empty):
    a, b = prose(21, 60), prose(22, 14)
    bench = [(1, a), (2, b), (3, "one two"), (4, None), (5, ""), (6, "Quick, BROWN fox!"), (6, "İstanbul ΑΣ straße x y z 1 2 3 4 5 6"), (7, a), (None, prose(7, 30)), (12, "upsilon7")]
    data = documents() + [(200, "pre " + a.upper() + " post", None, None, 1), (201, "x. " + " ".join(a.split()[5:16]) + " y", None, None, 1), (202, " ".join(a.split()[5:14]) + " y", None, None, 1), (203, b + " " + b, None, None, 1), (204, "the quick-brown fox; one, two", None, None, 1), (205, "İstanbul ΑΣ straße x y z 1 2 3 4 5 6", None, None, 1), (205, "i̇stanbul ας straße x y z 1 2 3 4 5 6", None, None, 1)]
    df = with_clashes(spark.createDataFrame(data, SCHEMA))
    bf = spark.createDataFrame(bench, SCHEMA_B)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.contamination(df, bf), *columns) == contamination(data, bench)
    assert rows(decontaminate.contamination(df, bf.limit(0)), *columns) == contamination(data, [])
    assert decontaminate.contamination(empty, bf).collect() == []
    clean = decontaminate.decontaminated(df, bf)
    bad = {r[0] for r in contamination(data, bench) if r[5]}
    assert clean.columns == df.columns and sorted(map(repr, (r["doc_id"] for r in clean.collect()))) == sorted(repr(d) for d, *_ in data if d is None or d not in bad)


# --- 8 ---------------------------------------------------------------------------
def kneser_ney(docs):
    def tokens(t):
        return [ascii_lower(x) for x in SPACE_WORD.findall(t or "")] + ["</s>"]

    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    big, uni = Counter(), Counter()
    for d, t, *_ in docs:
        if not fold(d):
            w = tokens(t)
            uni.update(w)
            big.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    types, total, by = Counter(), Counter(), {}
    for (a, b), c in big.items():
        types[b] += 1
        total[a] += c
        by.setdefault(a, Counter())[min(c, 3)] += 1
    d2 = ngram_lm.discounts([sum(c == k for c in big.values()) for k in (1, 2, 3, 4)])
    d1 = ngram_lm.discounts([sum(c == k for c in types.values()) for k in (1, 2, 3, 4)])
    disc = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    back = sum(disc(c, d1) for c in types.values())
    low = lambda w: (max(types[w] - disc(types[w], d1), 0) + back / (v + 1)) / len(big) if big else 1 / (v + 1)
    out = []
    for d, t, *_ in docs:
        w, s, b = tokens(t), 0.0, 0.0
        for x, y in zip(["<s>", *w], w):
            p = low(y)
            if total[x]:
                c = big[x, y]
                p = (max(c - disc(c, d2), 0) + sum(k_n * d2[k - 1] for k, k_n in by[x].items()) * p) / total[x]
            s += math.log10(p)
            b += math.log10((uni[y] + 1) / (n + v + 1))
        out.append((d, fold(d), len(w), sum(uni[y] > 0 for y in w), n, round(b, 6), round(s, 6)))
    return sorted(out, key=repr)


def test_lm_equals_brute_force(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_CHARS", 6000)
    monkeypatch.setattr(ngram_lm, "PORTION_CHARS", 20000)
    got = ngram_lm.lm_scores(docs).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=repr)
    assert got == kneser_ney(documents())
    assert ngram_lm.lm_scores(empty).collect() == []
    held = [d for d, *_ in documents() if d is not None and zlib.crc32(str(d).encode()) % 7 == 2]
    none = ngram_lm.lm_scores(docs.where(docs["doc_id"].isin(held))).collect()
    assert none and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)


def test_words_that_begin_many_bigrams_are_split(spark, monkeypatch):
    """Every first word of a quarter of a shard's bigrams or more, also one that is rare in each portion; scores do not change."""
    monkeypatch.setattr(ngram_lm, "SHARD_CHARS", 4800)
    monkeypatch.setattr(ngram_lm, "PORTION_CHARS", 2000)
    data = [(i, " ".join(["often"] * 20 + [f"x{i}y{j}" + (" rare" if j == 7 else "") for j in range(60)]), None, None, None) for i in range(260)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    model = ngram_lm.fit(df)
    h = lambda w: np.uint64(word_spans([w])[0][0])
    assert model.shards > 10 and h(b"often") in model.heavy and h(b"rare") in model.heavy and ngram_lm.BEGIN in model.heavy and len(model.heavy) < 8
    texts = [data[0][1], "rare often x1y1", "unseen"]
    got = model.score(texts)
    monkeypatch.setattr(ngram_lm, "SHARD_CHARS", 10**9)
    assert np.allclose(got["score"], ngram_lm.fit(df).score(texts)["score"])


def test_counts_beyond_32_bits(tmp_path):
    """A field is as wide as its largest value asks; both widths of one shard are read back."""
    keys = np.array([3, 8, 11], np.uint64)
    fields = [np.array([1, 2**33, 5], np.int64), np.array([7, 8, 9], np.int64), np.array([2**40, 0, 2**32 - 1], np.int64)]
    ngram_lm._store(f"{tmp_path}/words-0", keys, *fields)
    model = ngram_lm.Model(str(tmp_path), 1, 2**41, 3, 3, (0.5, 1.0, 1.5), (0.5, 1.0, 1.5), 1.0)
    got = model._rows("words", np.zeros(4, np.int64), np.array([11, 3, 5, 8], np.uint64), ("a", "b", "c"))
    assert got.tolist() == [[5, 9, 2**32 - 1], [1, 7, 2**40], [0, 0, 0], [2**33, 8, 0]]


def test_scores_of_frequent_words_use_whole_counts(spark, tmp_path, monkeypatch):
    """A model whose files say that a word came ten thousand million times."""
    data = [(i, "often rare often", None, None, None) for i in range(3)]
    model = ngram_lm.fit(spark.createDataFrame(data, SCHEMA))
    h = word_spans([b"often"])[0][0]
    keys, fields = ngram_lm._read(ngram_lm.mapped(f"{model.path}/words-0"), len(ngram_lm.WORD_FIELDS))
    fields = [f.astype(np.int64) for f in fields]
    fields[0][keys == h] = 10**10
    ngram_lm._store(f"{tmp_path}/words-0", keys, *fields)
    other = ngram_lm.Model(str(tmp_path), 1, 10**10 + 6, model.words, model.pairs, model.pair_discount, model.word_discount, model.word_backoff)
    got = other.score(["often"])["base_score"][0]
    assert got == pytest.approx(math.log10((10**10 + 1) / (10**10 + 6 + model.words + 1)) + math.log10(4 / (10**10 + 6 + model.words + 1)))


def test_lm_probabilities_add_up(spark):
    """After a word, all known words, the end and the unknown word have probability one together."""
    data = [(i, prose(i, 60, ["a", "b", "c", "d", "e"]), None, None, None) for i in range(30)]
    model = ngram_lm.fit(spark.createDataFrame(data, SCHEMA))
    words = sorted({w for _, t, *_ in data for w in t.split()})
    score = lambda texts: 10 ** model.score(texts)["score"].to_numpy()
    one = score(words + ["never-seen"])  # P(w | begin) * P(end | w)
    ends = np.array([score([f"{w} {w}"])[0] / score([w])[0] for w in words])  # P(w | w), the rest cancels
    assert (ends > 0).all() and (ends < 1).all()
    a, b = _tokens_of(model, words)
    assert a == pytest.approx(1.0) and b == pytest.approx(1.0) and (one > 0).all()


def _tokens_of(model, words):
    """Sums of P(. | begin) and P(. | first word) over the known words, the end and an unknown word."""
    real, sums = ngram_lm._tokens, []
    from brontide.llm.shared import word_hashes

    h = word_hashes([w.encode() for w in [*words, "never-seen"]])[0]
    target = np.append(h, ngram_lm.END)
    for context in (ngram_lm.BEGIN, h[0]):
        ngram_lm._tokens = lambda texts, c=context: (np.full(len(target), c, np.uint64), target, np.arange(len(target)))
        try:
            sums.append((10 ** model.score([""] * len(target))["score"]).sum())
        finally:
            ngram_lm._tokens = real
    return sums


# --- 9 ---------------------------------------------------------------------------
def greedy(word, pieces, longest):
    n = at = 0
    while at < len(word):
        for k in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + k] in pieces:
                break
        else:
            return 1
        at += k
        n += 1
    return n


def test_token_counts_equal_greedy(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = set(token_counts.byte_pieces(path))
    longest = max(map(len, pieces))
    want = sorted(((d, len((t or "").encode().split()), sum(greedy(b" " + w, pieces, longest) for w in (t or "").encode().split())) for d, t, *_ in documents()), key=repr)
    assert rows(token_counts.token_counts(docs, path), "doc_id", "n_words", "n_tokens") == want
    assert token_counts.token_counts(empty, path).collect() == []


def test_automaton_on_small_vocabularies():
    r = random.Random(6)
    for _ in range(40):
        pieces = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 5))) for _ in range(8)}
        m = token_counts.Automaton(sorted(pieces))
        words = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 12))) for _ in range(50)]
        end = np.cumsum([len(w) for w in words])
        got = m.counts(np.frombuffer(b"".join(words), np.uint8), end - [len(w) for w in words], end)
        assert got.tolist() == [greedy(w, pieces, 4) for w in words]


def test_very_long_words_take_linear_time():
    """A blob of 300,000 characters beside others, in a second or so; a word that cannot be cut."""
    import time

    path = public_tokenizers.path("byte_bpe_50k.json")
    machine = token_counts.automaton(path)
    r = random.Random(3)
    blob = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(300_000))
    short = [blob[:n] for n in (1, 50, 999)]
    begin = time.time()
    words, pieces = token_counts.count_texts([blob, " ".join(short), None, ""], machine)
    assert time.time() - begin < 15 and words.tolist() == [1, 3, 0, 0]
    known = set(token_counts.byte_pieces(path))
    longest = max(map(len, known))
    assert pieces.tolist() == [greedy(b" " + blob.encode(), known, longest), sum(greedy(b" " + w.encode(), known, longest) for w in short), 0, 0]
    few = token_counts.Automaton([b"a", b"ab", b"b"])
    data = np.frombuffer(b"ababcab", np.uint8)
    assert few.counts(data, np.array([0, 4]), np.array([4, 7])).tolist() == [2, 1]


# --- 10 --------------------------------------------------------------------------
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_token_files_hold_the_library_s_ids(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "RANGE_CHARS", 9000)
    monkeypatch.setattr(token_files, "RUN_CHARS", 3000)
    tok = Tokenizer.from_file(TOKENIZER)
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]
    got = sorted(token_files.token_files(docs, TOKENIZER).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d for d, *_ in documents()), key=lambda d: (d is not None, d or 0))
    at = 0
    left = Counter((d, zlib.crc32(np.array(ids(t), "<u4").tobytes()), len(ids(t))) for d, t, *_ in documents())
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        left[r["doc_id"], r["ids_crc32"], r["n_tokens"]] -= 1
    assert not +left
    assert token_files.token_files(empty, TOKENIZER).collect() == []


def test_words_encode_as_texts_do():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    r = random.Random(8)
    letters = "abcXYZ'’12é́​ 　İΑΣς.,!-_\x01\x1c\x85 \n\t|<>"
    texts = ["".join(r.choice(letters) for _ in range(80)) for _ in range(300)] + ["", None, "a \x01 b", "<|endoftext|>"]
    got, n = token_files.encode_texts(texts, TOKENIZER)
    want = [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == [x for w in want for x in w]


def test_codec_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.encode_values(v)
        assert len(control) == -(-n // 4)
        assert (token_files.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == v).all()
        ids, missing, counts = np.arange(n), np.zeros(n, bool), np.ones(n, np.uint32)
        back = token_files.unpack(token_files.pack(ids, missing, counts, v))
        assert all((a == b).all() for a, b in zip(back, (ids, missing, counts, v)))


# --- pipeline ----------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        seen[name] = docs.count()
        if name == "quality":
            want = {r["doc_id"] for r in quality.quality_scores(spark.createDataFrame(list(before.values()), docs.schema), labels).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "near_dups":
            assert {r["doc_id"] for r in docs.collect()} == {r[0] for r in components([tuple(r) for r in before.values()], 5, 80) if r[3]}
        if name == "decontaminate":
            bad = {r[0] for r in contamination([tuple(r) for r in before.values()], [tuple(r) for r in bench.collect()]) if r[5]}
            assert {r["doc_id"] for r in docs.collect()} == set(before) - bad
        if name != "tokens":
            assert docs.columns == columns
    end = sorted(docs.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in end] == sorted(r["doc_id"] for r in end) and seen["tokens"] == seen["mix"]
    starts = [r["start"] for r in end]
    assert starts == [0, *np.cumsum([r["n_tokens"] for r in end]).tolist()][:-1] and bisect.bisect(starts, -1) == 0
    assert corpus_pipeline.run(spark, sf).count() == seen["tokens"]


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, ties and clashing columns, then an empty table."""
    import corpus_pipeline

    data = [*documents(), (70, prose(61, 30000), "en", "s1", None), (71, "blob " + "Q" * 200_000, None, None, 3)]
    bench = [(1, " ".join(prose(2, 300).split()[40:60])), (2, None), (None, "one two")]
    df = with_clashes(spark.createDataFrame(data, SCHEMA))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, SCHEMA_B).write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r[0] for r in components(data, 5, 80) if r[3]}
    bad = {r[0] for r in contamination(data, bench) if r[5]}
    words = {d for d, t, *_ in data if SPACE_WORD.findall(t or "")}
    allowed = (kept - bad) & words
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and set(ids) <= allowed and 70 in ids and len(got) - len(ids) <= 1 and 6 not in ids
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()][:-1]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
