"""Greedy word-piece counts by a longest-match automaton.

A trie of the vocabulary has a failure link and a number of popped pieces at
every node. Where a word's next byte has no edge, the pieces that greedy
matching would cut off there are already counted at the node, and the link
leads to the node that spells what is left; no piece is built and no byte is
read twice. Edges are a hash table in arrays, so all distinct words of a batch
take each step together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .shared import as_bytes, chunks_by_bytes, mix64, word_spans

PORTION_CHARS = 6_000_000
#: Words that are walked one by one once all others of a portion have ended.
FEW = 16


class Automaton:
    """For pieces (byte strings). A word that no sequence of greedy pieces spells counts as one unknown piece."""

    def __init__(self, pieces: list[bytes]):
        child: list[dict[int, int]] = [{}]
        is_piece = [False]
        parent: list[tuple[int, int]] = [(0, 0)]
        for p in pieces:
            node = 0
            for byte in p:
                to = child[node].get(byte)
                if to is None:
                    to = len(child)
                    child[node][byte] = to
                    child.append({})
                    is_piece.append(False)
                    parent.append((node, byte))
                node = to
            is_piece[node] = bool(node)
        n = len(child)
        fail, pops = [-1] * n, [0] * n
        level = [0]
        while level:
            below = [to for node in level for to in child[node].values()]
            for node in below:
                up, byte = parent[node]
                if is_piece[node]:
                    fail[node], pops[node] = 0, 1
                    continue
                at, count = fail[up], pops[up]
                while at >= 0 and byte not in child[at]:
                    count += pops[at]
                    at = fail[at]
                if at >= 0:
                    fail[node], pops[node] = child[at][byte], count
            level = below
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self._edges(child)
        self._plain: tuple[dict[int, int], list[int], list[int]] | None = None

    def _edges(self, child: list[dict[int, int]]) -> None:
        key = np.array([node << 8 | byte for node, out in enumerate(child) for byte in out], np.int64)
        to = np.array([x for out in child for x in out.values()], np.int64)
        size = 1 << max(4, int(3 * len(key)).bit_length())
        self.mask = size - 1
        self.key, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        left = np.arange(len(key))
        at = self._home(key)
        self.probes = 0
        while len(left):  # one entry for each free place, the others move on
            self.probes += 1
            free = left[self.key[at[left]] == -1]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.key[at[put]], self.to[at[put]] = key[put], to[put]
            left = np.setdiff1d(left, put)
            at[left] = at[left] + 1 & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The edges' ends, -1 where there is none."""
        key = node << 8 | byte
        at = self._home(key)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for _ in range(self.probes):
            if not len(left):
                break
            there = self.key[at[left]]
            hit = there == key[left]
            out[left[hit]] = self.to[at[left[hit]]]
            left = left[~hit & (there != -1)]
            at[left] = at[left] + 1 & self.mask
        return out

    def _settle(self, node: np.ndarray, count: np.ndarray, byte: np.ndarray | None) -> np.ndarray:
        """Follow failure links until ``byte`` can be read, or without one until the root; -1 where neither comes."""
        to = self._step(node, byte) if byte is not None else np.where(node == 0, 0, -1)
        left = np.flatnonzero(to < 0)
        while len(left):
            count[left] += self.pops[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] >= 0]
            to[left] = self._step(node[left], byte[left]) if byte is not None else np.where(node[left] == 0, 0, -1)
            left = left[to[left] < 0]
        return to

    def _walk(self, node: int, count: int, data: bytes) -> int:
        """Pieces of one word from a state on, byte by byte; 1 if a byte can nowhere be read."""
        if self._plain is None:
            free = self.key >= 0
            self._plain = dict(zip(self.key[free].tolist(), self.to[free].tolist())), self.fail.tolist(), self.pops.tolist()
        edge, fail, pops = self._plain
        for byte in data:
            while (to := edge.get(node << 8 | byte, -1)) < 0:
                count += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            count += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return count

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of the words data[start:end]; words in order of length drop out as they end, and the last FEW are walked one by one."""
        order = np.argsort(start - end, kind="stable")
        s, length = start[order], (end - start)[order]
        count = np.zeros(len(s), np.int64)
        node = np.zeros(len(s), np.int64)
        dead = np.zeros(len(s), bool)
        alive = np.searchsorted(-length, -np.arange(1, (int(length[0]) if len(s) else 0) + 1), side="right")
        long = 0
        for i, n in enumerate(alive):
            if n <= FEW:
                long = int(n)
                break
            ok = np.flatnonzero(~dead[:n])
            at, c = node[ok], count[ok]
            to = self._settle(at, c, data[s[ok] + i].astype(np.int64))
            count[ok] = c
            node[ok] = to
            dead[ok[to < 0]] = True
        for j in range(long):
            if not dead[j]:
                count[j] = self._walk(int(node[j]), int(count[j]), data[s[j] + i : s[j] + length[j]].tobytes())
        ok = long + np.flatnonzero(~dead[long:])
        at, c = node[ok], count[ok]
        dead[ok[self._settle(at, c, None) < 0]] = True
        count[ok] = c
        count[dead] = 1
        out = np.empty_like(count)
        out[order] = count
        return out


def byte_pieces(path: str) -> list[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes; its stand-ins for control bytes and the space are undone."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [bytes(back[c] for c in piece) for piece in vocabulary if all(c in back for c in piece)]


@lru_cache(4)
def automaton(path: str) -> Automaton:
    return Automaton(byte_pieces(path))


def count_texts(texts: list[str | None], machine: Automaton, marker: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """(words, pieces) of each text; ``marker`` stands before each word."""
    words, pieces = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    data = as_bytes(texts)
    for part in chunks_by_bytes([len(t) for t in data], PORTION_CHARS):
        batch = data[part]
        h, at, start, end = word_spans(batch)
        n = np.diff(at)
        base = np.cumsum([0] + [len(t) + 1 for t in batch])[:-1]
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        shift = np.repeat(base, n)[first]
        whole = b" ".join(batch)
        begin, stop = start[first] + shift, end[first] + shift
        # Each distinct word once, behind its marker.
        joined = np.frombuffer(b"".join(marker + whole[b:e] for b, e in zip(begin, stop)), np.uint8)
        size = stop - begin + len(marker)
        to = np.cumsum(size)
        counts = machine.counts(joined, to - size, to)[inverse]
        words[part] = n
        pieces[part] = np.bincount(np.repeat(np.arange(len(n)), n), counts, len(n)).astype(np.int64)
    return words, pieces


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of ``docs`` (doc_id, text).

    Words are parted by ASCII white space; each is cut, behind a space, into the
    longest pieces of the vocabulary from the left; a word that cannot be cut counts
    as one. Null and empty texts have none. Rows that repeat are counted each, an
    empty table gives an empty one, other columns are not read, and single words
    of any length take time in proportion to it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton(vocabulary)
        for b in batches:
            words, pieces = count_texts(b["text"].tolist(), machine)
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": words, "n_tokens": pieces})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_words long, n_tokens long")
