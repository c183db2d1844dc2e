"""Many regular expressions over many texts: one automaton of their required texts first, then only the expressions that can match."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

try:
    import ahocorasick
except ImportError:  # pragma: no cover  the texts are then looked up one by one
    ahocorasick = None

_PLAIN = re.compile(r"[A-Za-z0-9 ,/_-]+")


def required_text(pattern: str) -> str:
    """The longest text, lower-cased, that every match of a pattern holds; empty if none is sure.

    Groups, classes, escapes and dots end a text, a quantifier takes its last
    character away, and a pattern with an alternation outside groups has none.
    """
    depth, outside = 0, ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            outside += "" if depth else "\0"
            i += 2
            continue
        if c == "[":
            i = pattern.index("]", i + 2)
            c = "\0"
        if c in "()":
            depth += 1 if c == "(" else -1
            c = "\0"
        elif depth:
            c = ""
        elif c == "|":
            return ""
        outside += c
        i += 1
    outside = re.sub(r".[?*{]", "\0", outside)
    found = [m.group().lower() for m in _PLAIN.finditer(outside.replace("}", "\0"))]
    return max(found, key=len, default="")


@lru_cache(maxsize=16)
def _automaton(texts: tuple[str, ...]):
    """An automaton whose words lead to the bits of the patterns that need them, and the bits that need nothing."""
    bits: dict[str, int] = {}
    for i, t in enumerate(texts):
        bits[t] = bits.get(t, 0) | 1 << i
    always = bits.pop("", 0)
    if ahocorasick is None:
        return bits, always
    machine = ahocorasick.Automaton()
    for t, b in bits.items():
        machine.add_word(t, b)
    machine.make_automaton()
    return machine, always


def _bits(machine, bits: int, low: str) -> int:
    """``bits`` and those of the patterns whose texts a lower-cased text holds."""
    if ahocorasick is None:
        for t, b in machine.items():
            bits |= b if t in low else 0
    elif len(machine):
        for _, b in machine.iter(low):
            bits |= b
    return bits


class PatternSet:
    """Patterns that are looked for together, letters in either case."""

    def __init__(self, patterns: Sequence[str]):
        self.number = {p: i for i, p in enumerate(dict.fromkeys(patterns))}
        self.texts = tuple(required_text(p) for p in self.number)

    def matcher(self):
        """A function of a text that gives its ``Matches``; for use inside tasks."""
        machine, always = _automaton(self.texts)
        names = list(self.number)
        compiled = [re.compile(p, re.IGNORECASE) for p in names]

        def match(text: str) -> Matches:
            return Matches(self, text, _bits(machine, always, text.lower()), names, compiled)

        return match


class Matches:
    """Which patterns occur in one text: those whose required texts it lacks do not, the others are run when asked for, once."""

    def __init__(self, patterns: PatternSet, text: str, bits: int, names: list[str], compiled: list[re.Pattern]):
        self.patterns, self.text, self.bits, self.names, self.compiled, self.known = patterns, text, bits, names, compiled, {}

    def __iter__(self):
        """Patterns that may occur."""
        bits = self.bits
        while bits:
            low = bits & -bits
            yield self.names[low.bit_length() - 1]
            bits ^= low

    def __bool__(self) -> bool:
        return bool(self.bits)

    def __call__(self, pattern: str) -> bool:
        i = self.patterns.number[pattern]
        if not self.bits >> i & 1:
            return False
        if i not in self.known:
            self.known[i] = self.compiled[i].search(self.text) is not None
        return self.known[i]
