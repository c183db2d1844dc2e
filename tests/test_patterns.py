"""The automaton never rules out a pattern that matches, and labels are those of all expressions run one by one."""

import random
import re

import pytest
from brontide.functions import patterns as P
from brontide.operators.fields import FIELD_SPECS

ALL = [p for s in FIELD_SPECS for p in (*s.keywords, *s.anti)]


@pytest.mark.parametrize("pattern,text", [
    (r"soil moisture", "soil moisture"), (r"\bcape\b", "cape"), (r"volumetric.*soil", "volumetric"), (r"river.*(warning|danger) level", " level"), (r"a|b", ""), (r"(a|b)", ""), (r"colou?r code", "r code"), (r"x[abc]yz", "yz"),
    (r"\d+ hours?", " hour"), (r"ab{2}cde", "cde"), (r"Snow DEPTH", "snow depth"), (r".*", ""),
])
def test_required_texts(pattern, text):
    assert P.required_text(pattern) == text


def samples(n):
    r = random.Random(4)
    pieces = [P.required_text(p) for p in ALL] + ["at 2 m", "hPa", "mean", "Höhe", "", "fore", "cast", "(danger)", "warning level", "very rough"]
    texts = [" ".join(r.choice(pieces) for _ in range(r.randrange(6))) for _ in range(n)]
    return [t.upper() if r.random() < 0.3 else t for t in texts] + [None, "", "İ soil MOISTURE"]


def test_matches_are_those_of_every_expression(monkeypatch):
    """With the automaton and without it; the texts in either case."""
    found = P.PatternSet(ALL)
    want = [[p for p in found.number if re.search(p, t or "", re.I)] for t in samples(400)]
    for machine in (P.ahocorasick, None):
        monkeypatch.setattr(P, "ahocorasick", machine)
        P._automaton.cache_clear()
        match = found.matcher()
        for t, w in zip(samples(400), want):
            may = match(t or "")
            assert [p for p in found.number if may(p)] == w and set(w) <= set(may) and bool(may) >= bool(w)
    P._automaton.cache_clear()


def test_most_expressions_are_not_run():
    match = P.PatternSet(ALL).matcher()
    assert sum(len(list(match(t))) for t in ("2 metre temperature", "u component of wind", "total column ozone")) < 20
