"""Whole licence texts in the scan, and boosted trees beside a plain rewriting of the fit."""

import numpy as np
import pytest

from brontide.llm import licenses, quality
from brontide.llm.license_texts import TEXTS


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["license"]): r for r in licenses.license_scan(df).collect()}


def test_every_whole_text_is_found_however_it_is_set(spark):
    names = list(TEXTS)
    wrapped = ["/*\n * Copyright (c) 2020 Someone\n *\n * " + TEXTS[n].replace("\n", "\n * ").replace(". ", ".\n *    ") + "\n */\nint main() {}" for n in names]
    got = scan(spark, *wrapped)
    for i, n in enumerate(names):
        row = got[i, n]
        assert row["coverage"] == 1.0 and row["matched"] == row["template_words"], n
        inside = wrapped[i][row["start"] : row["end"]]
        assert inside[:4] == TEXTS[n].lstrip("123. ")[:4] or inside[0] == "1", n


def test_texts_that_lack_a_part(spark):
    bsd2, bsd3, mit = TEXTS["BSD-2-Clause-text"], TEXTS["BSD-3-Clause-text"], TEXTS["MIT-text"]
    first_only, other_tail = mit.split("\nTHE SOFTWARE")[0], mit.split("\nTHE SOFTWARE")[0] + " and some other words that no licence has " * 20
    got = scan(spark, bsd2, bsd3, first_only, other_tail, mit.replace("AUTHORS OR COPYRIGHT HOLDERS", "MAKERS"))
    for i, mine, other in ((0, "BSD-2", "BSD-3"), (1, "BSD-3", "BSD-2")):  # a clause is wider than the band
        assert got[i, f"{mine}-Clause-text"]["coverage"] == 1.0 and (i, f"{other}-Clause-text") not in got
    for i in (2, 3):
        assert (i, "MIT-text") not in got and got[i, "MIT"]["coverage"] == 1.0
    assert 0.95 < got[4, "MIT-text"]["coverage"] < 1.0


def plain_fit(x, y, trees, depth, rate, cuts, least, ridge):
    """Boosting that tries every cut of every node, a row at a time: nested tuples (feature, cut, left, right) with numbers as leaves."""
    raw, made = [float(np.log(y.mean() / (1 - y.mean())))] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + np.exp(-r)) for r in raw]
        g, h = [b - a for a, b in zip(p, y)], [a * (1 - a) for a in p]

        def total(rows, v):
            return sum(v[i] for i in rows)

        def grow(rows, level):
            if level == depth:
                return rate * total(rows, g) / (total(rows, h) + ridge)
            best = (1e-9, None, None)
            for j in range(x.shape[1]):
                for cut in cuts[j]:
                    left, right = [i for i in rows if x[i, j] <= cut], [i for i in rows if x[i, j] > cut]
                    if min(total(left, h), total(right, h)) < least / 4:
                        continue
                    gain = sum(total(s, g) ** 2 / (total(s, h) + ridge) for s in (left, right)) - total(rows, g) ** 2 / (total(rows, h) + ridge)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, cut)
            _, j, cut = best
            if j is None:
                return grow(rows, level + 1)
            return j, cut, grow([i for i in rows if x[i, j] <= cut], level + 1), grow([i for i in rows if x[i, j] > cut], level + 1)

        tree = grow(range(len(y)), 0)
        made.append(tree)
        raw = [r + walk(tree, x[i]) for i, r in enumerate(raw)]
    return [1 / (1 + np.exp(-r)) for r in raw]


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed", range(3))
def test_fit_equals_trying_every_cut(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(120, 3)).astype(np.float32)
    x[:, 1] = np.round(x[:, 1])  # ties
    y = ((x[:, 0] + x[:, 1] > 0.3) ^ (r.random(120) < 0.1)).astype(float)
    bins = 8
    cuts = [sorted({float(np.float32(q)) for q in np.quantile(x[:, j], [k / bins for k in range(1, bins)])}) for j in range(3)]
    got = quality.fit_trees(x, y, trees=3, depth=2, bins=bins).scores(x)
    want = plain_fit(x, y, 3, 2, 0.15, cuts, 8.0, 1.0)
    assert np.allclose(got, want, atol=1e-9)


def test_fit_without_two_classes():
    x = np.zeros((4, 2), np.float32)
    for y, want in ((np.ones(4), 0.999), (np.zeros(4), 0.001)):
        assert quality.fit_trees(x, y).scores(x)[0] == pytest.approx(want, abs=1e-3)
    assert quality.fit_trees(x[:0], np.zeros(0)).scores(x)[0] == 0.5
